"""Local shape of a cloud: covariances of neighbours and what follows from them, in column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.spatial import by_place, in_blocks, nearest, tiles

PAIRS = ("xx", "yy", "zz", "xy", "xz", "yz")


def covariances(cloud: DataFrame, k: int = 20, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(pid, n, cxx, ..., cyz): sample covariances of the k nearest points, themselves included, nearness measured in `dims`."""
    at = cloud.select(F.col("pid").alias("other"), *[F.col(d).alias(f"n{d}") for d in "xyz"])
    near = nearest(cloud, cloud, k, dims).join(at, "other")
    return near.groupBy("pid").agg(F.count("*").alias("n"), *[F.covar_samp(f"n{p[0]}", f"n{p[1]}").alias(f"c{p}") for p in PAIRS])


def smallest_eigenvalue() -> Column:
    """Of the covariance columns, by the trigonometric solution for symmetric 3x3 matrices."""
    xx, yy, zz, xy, xz, yz = (F.col(f"c{p}") for p in PAIRS)
    q = (xx + yy + zz) / 3
    a, b, c = xx - q, yy - q, zz - q
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt((a * a + b * b + c * c + 2 * off) / 6)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), det / (2 * p * p * p)))
    return F.when(p < 1e-300, q).otherwise(q + 2 * p * F.cos(F.acos(r) / 3 + 2 * math.pi / 3))


def shape(cloud: DataFrame, k: int = 20, dims: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(pid, curvature, planarity, nx, ny, nz, verticality): least eigenvalue's share of the trace, its complement, and the unit normal that points up. Fewer than three neighbours or no extent: 0 and the vertical."""
    df = covariances(cloud, k, dims).withColumn("l", F.abs(smallest_eigenvalue())).withColumn("trace", F.col("cxx") + F.col("cyy") + F.col("czz"))
    some = (F.col("n") >= 3) & (F.col("trace") > 1e-10)
    share = F.when(some, F.col("l") / F.nullif(F.col("trace"), F.lit(0.0)))
    # the normal is orthogonal to the rows of C - l I: the longest of their cross products
    xx, yy, zz, xy, xz, yz = (F.col(f"c{p}") for p in PAIRS)
    rows = [(xx - F.col("l"), xy, xz), (xy, yy - F.col("l"), yz), (xz, yz, zz - F.col("l"))]
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    options = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    square = lambda n: n[0] * n[0] + n[1] * n[1] + n[2] * n[2]
    df = df.withColumn("best", F.greatest(*[F.struct(square(n).alias("s"), *[x.alias(f"n{d}") for x, d in zip(n, "xyz", strict=True)]) for n in options]))
    length = F.sqrt("best.s")
    up = F.when(F.col("best.nz") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    unit = [F.when(some & (length > 1e-300), up * F.col(f"best.n{d}") / F.nullif(length, F.lit(0.0))).otherwise(F.lit(1.0 if d == "z" else 0.0)) for d in "xyz"]
    df = df.select("pid", F.coalesce(share, F.lit(0.0)).alias("curvature"), F.coalesce(1 - share, F.lit(0.0)).alias("planarity"), *[u.alias(f"n{d}") for u, d in zip(unit, "xyz", strict=True)])
    return df.withColumn("verticality", 1 - F.abs("nz"))


def height_proxy(cloud: DataFrame, k: int = 10) -> DataFrame:
    """(pid, curvature, verticality) from the height range of the k nearest points in the plane."""
    span = cloud.agg((F.max("z") - F.min("z")).alias("span"))
    near = nearest(cloud, cloud, k, ("x", "y")).join(cloud.select(F.col("pid").alias("other"), F.col("z").alias("oz")), "other")
    rise = near.groupBy("pid").agg((F.max("oz") - F.min("oz")).alias("rise")).join(F.broadcast(span))
    return rise.select("pid", (F.col("rise") / F.when(F.col("span") > 0, F.col("span")).otherwise(F.lit(1.0))).alias("curvature"), F.least(F.lit(1.0), F.col("rise") / 2).alias("verticality"))


class _Offsets:
    """Sums of offsets from each point of a block to those within r."""

    def __init__(self, own: dict[str, np.ndarray], r: float):
        self.own, self.r = by_place(own, r), r
        self.sums = np.zeros((3, len(own["pid"])))

    def meet(self, other: dict[str, np.ndarray]) -> None:
        for rows, _, steps, within in tiles(self.own, other, self.r):
            for total, step in zip(self.sums, steps, strict=True):
                total[rows] += np.einsum("ij,ij->i", step, within)

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.own["pid"], *self.sums)], ["pid", "sx", "sy", "sz"])


def mean_offsets(cloud: DataFrame, r: float) -> DataFrame:
    """(pid, nx, ny, nz): unit sum of offsets to the neighbours within r in space; (0, 1, 0) if they cancel out."""
    total = in_blocks(cloud, r, (), lambda own: _Offsets(own, r), "pid bigint, sx double, sy double, sz double")
    length = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz"))
    return total.select("pid", *[F.when(length > 1e-12, F.col(f"s{d}") / F.nullif(length, F.lit(0.0))).otherwise(F.lit(1.0 if d == "y" else 0.0)).alias(f"n{d}") for d in "xyz"])
