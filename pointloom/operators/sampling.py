"""Samples of a cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stride(cloud: DataFrame, n: int, most: int) -> DataFrame:
    """Every (n // most)-th point by pid, `most` of them; n is the number of points, pids count from 0."""
    step = max(1, n // most) if most else 1
    return cloud.where((F.col("pid") % step == 0) & (F.floor(F.col("pid") / step) < most))


def level_of_detail(cloud: DataFrame, n: int, most: int = 2_000_000) -> DataFrame:
    """What is drawn of a cloud of n points: all of it, or the points floor(i * n / most)."""
    if n <= most:
        return cloud
    step = n / most
    k = F.ceil(F.col("pid") / step)
    return cloud.where(F.floor(k * step) == F.col("pid"))


def voxels(cloud: DataFrame, size: float) -> DataFrame:
    """(ix, iy, iz, n, x, y, z): one mean point per occupied voxel."""
    cell = [F.floor(F.col(d) / size).alias(f"i{d}") for d in "xyz"]
    return cloud.groupBy(*cell).agg(F.count("*").alias("n"), *[F.avg(d).alias(d) for d in "xyz"])


def random(cloud: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """A share of the points that depends on pid and seed only, not on the partitioning."""
    return cloud.where(F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(1 << 30)) < int(fraction * (1 << 30)))


def windows(cloud: DataFrame, n: int, size: int = 40_960, overlap: int = 2_048) -> DataFrame:
    """The cloud with a window number: windows of `size` points by pid, each sharing `overlap` points with the one before; a point in two windows comes twice. Pids count from 0; one of n or above is an error."""
    step = size - overlap
    last = max(0, -(-(n - size) // step)) if n > size else 0
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("pid") - (size - 1)) / step))
    pid = F.when(F.col("pid") < n, F.col("pid")).otherwise(F.raise_error(F.concat(F.lit(f"pid beyond the {n} points: "), F.col("pid").cast("string"))))
    return cloud.withColumn("pid", pid).withColumn("window", F.explode(F.sequence(first, F.least(F.lit(last).cast("long"), F.floor(F.col("pid") / step)))))
