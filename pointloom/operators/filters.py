"""Filters: each keeps a subset of the rows with all their columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.prefix import at_rank, named, ranked
from pointloom.operators.spatial import finite, nearest, neighbours, radius_counts

DIMS = ("x", "y", "z")


def finite_points(cloud: DataFrame) -> DataFrame:
    return cloud.where(finite(*DIMS))


def percentile_box(cloud: DataFrame, cut: float = 0.005, pad: float = 0.1) -> DataFrame:
    """Drops points outside the box from sorted[floor(n * cut)] to sorted[floor(n * (1 - cut))] of each axis, widened by `pad` of its size; clouds of up to 100 points stay whole."""
    points = finite_points(cloud)
    ranks = ranked(named(points, {d: F.col(d) for d in DIMS}))
    ends = ranks.groupBy("name", "n").agg(at_rank(F.floor(F.col("n") * cut)).alias("lo"), at_rank(F.floor(F.col("n") * (1 - cut))).alias("hi"))
    one = ends.groupBy().agg(F.max("n").alias("total"), *[F.max(F.when(F.col("name") == d, F.col(c))).alias(f"{c}_{d}") for d in DIMS for c in ("lo", "hi")])
    inside = F.col("total") <= 100
    within = F.lit(True)
    for d in DIMS:
        margin = (F.col(f"hi_{d}") - F.col(f"lo_{d}")) * pad
        within &= F.col(d).between(F.col(f"lo_{d}") - margin, F.col(f"hi_{d}") + margin)
    return points.join(F.broadcast(one)).where(inside | within).select(*cloud.columns)


def knn_mean_distance(cloud: DataFrame, k: int, with_self: bool = True) -> DataFrame:
    """(pid, mean_distance) in space over the k nearest points, the point itself (distance 0) among them or not."""
    near = nearest(cloud, cloud, k if with_self else k + 1, DIMS)
    near = near if with_self else near.where("pid <> other")
    return near.groupBy("pid").agg((F.sum(F.sqrt("d2")) / F.count("*")).alias("mean_distance"))


def statistical(cloud: DataFrame, k: int = 20, std_dev: float = 1.0) -> DataFrame:
    """Keeps points whose mean distance to their k nearest, themselves included, is within std_dev population deviations of the mean, on both sides; fewer than k points stay as they are."""
    d = knn_mean_distance(cloud, k)
    one = d.agg(F.avg("mean_distance").alias("m"), F.stddev_pop("mean_distance").alias("s"), F.count("*").alias("n"))
    kept = d.join(F.broadcast(one)).where((F.col("n") < k) | (F.abs(F.col("mean_distance") - F.col("m")) <= std_dev * F.col("s"))).select("pid")
    return cloud.join(kept, "pid", "left_semi")


def outlier_removal(cloud: DataFrame, ratio: float = 2.0, k: int | None = None) -> DataFrame:
    """The one-sided variant: drops points that are farther than the mean plus ratio sample deviations. k is min(20, max(5, n / 1000)); up to 50 points stay."""
    n = cloud.count()
    if n <= 50:
        return cloud
    d = knn_mean_distance(cloud, k or min(20, max(5, n // 1000)))
    one = d.agg(F.avg("mean_distance").alias("m"), F.stddev_samp("mean_distance").alias("s"))
    kept = d.join(F.broadcast(one)).where(F.col("mean_distance") < F.col("m") + ratio * F.col("s")).select("pid")
    return cloud.join(kept, "pid", "left_semi")


def radius(cloud: DataFrame, r: float = 0.5, min_neighbors: int = 5, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """Keeps points with at least min_neighbors points within r, themselves included."""
    return cloud.join(radius_counts(cloud, r, dims).where(F.col("n") >= min_neighbors), "pid", "left_semi")


def gaussian(cloud: DataFrame, sigma: float, r: float) -> DataFrame:
    """Smooths coordinates: the mean over the ball of radius r, weighted by exp(-d^2 / 2 sigma^2)."""
    at = cloud.select(F.col("pid").alias("other"), *[F.col(d).alias(f"o_{d}") for d in DIMS])
    w = F.exp(-F.col("d2") / (2 * sigma * sigma))
    smooth = neighbours(cloud, cloud, r, DIMS).join(at, "other").groupBy("pid").agg(*[(F.sum(w * F.col(f"o_{d}")) / F.sum(w)).alias(f"s_{d}") for d in DIMS])
    others = [c for c in cloud.columns if c not in DIMS]
    return cloud.join(smooth, "pid").select(*others, *[F.col(f"s_{d}").alias(d) for d in DIMS]).select(*cloud.columns)


def in_box(lo: tuple[float, float, float], hi: tuple[float, float, float]) -> Column:
    """Inside the axis-parallel box, borders included."""
    test = F.lit(True)
    for d, a, b in zip(DIMS, lo, hi, strict=True):
        test &= F.col(d).between(a, b)
    return test


def in_oriented_box(centre: tuple[float, float, float], half: tuple[float, float, float], yaw: float) -> Column:
    """Inside the box turned by yaw about the vertical, borders included."""
    dx, dy, dz = (F.col(d) - c for d, c in zip(DIMS, centre, strict=True))
    c, s = math.cos(yaw), math.sin(yaw)
    return (F.abs(dx * c + dy * s) <= half[0]) & (F.abs(dy * c - dx * s) <= half[1]) & (F.abs(dz) <= half[2])


def in_circle(x: float, y: float, r: float) -> Column:
    dx, dy = F.col("x") - x, F.col("y") - y
    return dx * dx + dy * dy <= r * r


def in_polygon(corners: list[tuple[float, float]]) -> Column:
    """Inside a simple polygon of the plane, by crossings of a ray."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        if ay != by:
            crosses = ((F.lit(ay) > F.col("y")) != (F.lit(by) > F.col("y"))) & (F.col("x") < (bx - ax) * (F.col("y") - ay) / (by - ay) + ax)
            inside = inside != crosses
    return inside


def above_plane(a: tuple, b: tuple, c: tuple) -> Column:
    """On the non-negative side of the plane through three points."""
    u, v = [q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)]
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    length = math.sqrt(sum(k * k for k in n)) or 1.0
    n = tuple(k / length for k in n)
    return n[0] * (F.col("x") - a[0]) + n[1] * (F.col("y") - a[1]) + n[2] * (F.col("z") - a[2]) >= 0


def on_screen(matrix: list[float], width: float, height: float, rect: tuple[float, float, float, float]) -> Column:
    """Whether the row-major 4x4 view-projection puts the point inside the pixel rectangle (x0, y0, x1, y1); w = 0 is outside."""
    row = lambda k: matrix[4 * k] * F.col("x") + matrix[4 * k + 1] * F.col("y") + matrix[4 * k + 2] * F.col("z") + matrix[4 * k + 3]
    w = F.nullif(row(3), F.lit(0.0))
    px, py = (row(0) / w + 1) / 2 * width, (1 - row(1) / w) / 2 * height
    return F.coalesce(px.between(rect[0], rect[2]) & py.between(rect[1], rect[3]), F.lit(False))


def unprojected(matrix: list[float], width: float, height: float, pixel: tuple[float, float], depth: float) -> tuple[float, float, float]:
    """The place behind a pixel at a depth of 0 (near) to 1 (far), the inverse of the row-major 4x4 view-projection; one that can't be inverted is an error."""
    at = np.linalg.inv(np.reshape(matrix, (4, 4))) @ [2 * pixel[0] / width - 1, 1 - 2 * pixel[1] / height, 2 * depth - 1, 1]
    x, y, z = at[:3] / (at[3] or 1.0)
    return float(x), float(y), float(z)


def screen_bounds(cloud: DataFrame, matrix: list[float], width: float, height: float, rect: tuple[float, float, float, float], heights: tuple[float, float] | None = None) -> dict:
    """The box {lo, hi} that a pixel rectangle (x0, y0, x1, y1) marks: its corners' rays meet the plane of the mean height, a level ray ends at its far point; without `heights` the box spans the cloud's, widened by a twentieth on both sides."""
    z = cloud.agg(F.avg("z").alias("mean"), F.min("z").alias("low"), F.max("z").alias("top")).first()
    if z["mean"] is None:
        raise ValueError("no points")
    met = []
    for pixel in ((x, y) for x in (rect[0], rect[2]) for y in (rect[1], rect[3])):
        near, far = (np.array(unprojected(matrix, width, height, pixel, d)) for d in (0, 1))
        way = far - near
        level = abs(way[2]) < 1e-6 * np.linalg.norm(way) or not way.any()
        met.append(far if level else near + way * (z["mean"] - near[2]) / way[2])
    pad = (z["top"] - z["low"]) / 20
    low, top = heights or (z["low"] - pad, z["top"] + pad)
    (x0, y0), (x1, y1) = np.min(met, 0)[:2].tolist(), np.max(met, 0)[:2].tolist()
    return {"lo": (x0, y0, low), "hi": (x1, y1, top)}


def split(cloud: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """Inner and outer part with all columns."""
    flag = F.coalesce(inside, F.lit(False))
    return cloud.where(flag), cloud.where(~flag)


def check_split(cloud: DataFrame, inside: Column) -> str | None:
    """What is wrong with a crop, if anything."""
    n, inner = cloud.agg(F.count("*"), F.count_if(inside)).first()
    return "no points" if not n else "nothing inside" if not inner else "nothing outside" if inner == n else None


def set_height(box: dict, low: float, high: float) -> dict:
    """A crop region with new z bounds: of an axis-parallel box {lo, hi} or an oriented one {centre, half, yaw}."""
    if "lo" in box:
        return box | {"lo": (*box["lo"][:2], low), "hi": (*box["hi"][:2], high)}
    return box | {"centre": (*box["centre"][:2], (low + high) / 2), "half": (*box["half"][:2], max(0.001, (high - low) / 2))}


def building_candidate(low: float, high: float, flat: float) -> Column:
    """High enough, and flat or well above the least height."""
    return F.col("z").between(low, high) & ((F.col("planarity") > flat) | (F.col("z") > 1.5 * low))


def trunk_height(spacing: float, fallback: bool = False, relaxed: bool = False) -> Column:
    """Heights at which trunks are looked for."""
    if relaxed:
        return F.col("z").between(0.3, 12.0)
    low = max(0.3, 3 * spacing)
    return F.col("z").between(low, max(3.0, 20 * spacing) if fallback else 15.0)


def within_range(column: str, low: float, high: float) -> Column:
    """Points that a display range of a scalar shows: both ends are in it, nulls are not."""
    return F.coalesce(F.col(column).between(low, high), F.lit(False))


def picked(cloud: DataFrame, origin: tuple[float, float, float], direction: tuple[float, float, float], reach: float = 1.0) -> DataFrame:
    """The point that a ray hits first: of those at most `reach` from the ray, ahead of its origin, the one whose foot on the ray is nearest, with that distance; ties go to the least pid. Only one row per task is compared in the end."""
    length = math.sqrt(sum(d * d for d in direction))
    offset = [F.col(c) - o for c, o in zip(DIMS, origin, strict=True)]
    along = sum(x * (d / length) for x, d in zip(offset, direction, strict=True))
    rows = cloud.withColumn("distance", along).where((F.col("distance") >= 0) & (sum(x * x for x in offset) - F.col("distance") * F.col("distance") <= reach * reach))
    return rows.orderBy("distance", "pid").limit(1)
