"""Aggregates of a cloud."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.prefix import named, one_row, quantiles
from pointloom.operators.spatial import finite, nearest


def bbox(cloud: DataFrame) -> DataFrame:
    """Unrounded bounds of finite points, one row."""
    return cloud.where(finite("x", "y", "z")).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def statistics(cloud: DataFrame) -> DataFrame:
    """Count, bounds, means, extent and XY density of finite points, one row, rounded to 2 places. Without intensities their range is 0..255 and their mean 128."""
    has = {c.lower() for c in cloud.columns}
    per = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    i = F.col("intensity") if "intensity" in has else F.lit(None).cast("double")
    per += [F.coalesce(F.min(i), F.lit(0.0)).alias("min_intensity"), F.coalesce(F.max(i), F.lit(255.0)).alias("max_intensity"), F.coalesce(F.avg(i), F.lit(128.0)).alias("avg_intensity")]
    if "radial_distance" in has:
        per += [f("radial_distance").alias(f"{n}_radial_distance") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    one = cloud.where(finite("x", "y", "z")).agg(F.count("*").alias("n"), *per)
    width, depth, height = (F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz")
    one = one.withColumns({"extent_x": width, "extent_y": depth, "extent_z": height})
    area = F.col("extent_x") * F.col("extent_y")
    one = one.withColumn("density", F.when(area > 0, F.col("n") / area).otherwise(F.lit(0.0)))
    return one.select("n", *[F.floor(c).alias(c) if "intensity" in c else F.round(c, 2).alias(c) for c in one.columns if c != "n"])


def scalar_fields(cloud: DataFrame, fields: Sequence[str] = ("x", "y", "z", "intensity", "radial_distance", "gps_time", "return_number", "number_of_returns")) -> DataFrame:
    """(field, min, max, avg) of each field that the cloud has."""
    have = [f for f in fields if f in cloud.columns]
    one = cloud.where(finite("x", "y", "z")).agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in have for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])
    rows = [F.struct(F.lit(c).alias("field"), *[F.col(f"{n}_{c}").alias(n) for n in ("min", "max", "avg")]) for c in have]
    return one.select(F.inline(F.array(*rows)))


def instance_stats(points: DataFrame, *keys: str) -> DataFrame:
    """Count and height range of each instance."""
    return points.groupBy(*keys).agg(F.count("*").alias("count"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"))


def category_summary(points: DataFrame, category: str = "category", instance: str = "instance_id") -> DataFrame:
    """Points and instances of each category and, with a null category, of all."""
    return points.rollup(category).agg(F.count("*").alias("points"), F.count_distinct(category, instance).alias("instances"))


def class_histogram(points: DataFrame, label: str = "classification") -> DataFrame:
    """(label, n, percent)."""
    counts = points.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def spacing(cloud: DataFrame) -> DataFrame:
    """(spacing): median XY distance to the nearest other point; 0.05 below ten points."""
    near = nearest(cloud, cloud, 1, ("x", "y"), skip_self=True)
    one = one_row(quantiles(named(near, {"d": F.sqrt("d2")}), [0.5]), ["d"]).select(F.col("d")[0].alias("median"))
    return cloud.agg(F.count("*").alias("n")).join(F.broadcast(one)).select(F.when(F.col("n") < 10, F.lit(0.05)).otherwise(F.col("median")).alias("spacing"))


def extent_spacing(cloud: DataFrame) -> DataFrame:
    """(by_extent, by_area): spacing from the bounds: longest side / sqrt(n), at least 0.01, and sqrt(area / n), at least 0.02."""
    one = cloud.agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("d"))
    n = F.greatest(F.col("n"), F.lit(1))
    return one.select(F.greatest(F.lit(0.01), F.greatest("w", "d") / F.sqrt(n)).alias("by_extent"), F.greatest(F.lit(0.02), F.sqrt(F.col("w") * F.col("d") / n)).alias("by_area"))


def percentiles(cloud: DataFrame, column: str | Column, at: Sequence[float]) -> DataFrame:
    """One row with the interpolated percentiles p<100 * at>."""
    one = one_row(quantiles(named(cloud, {"p": F.col(column) if isinstance(column, str) else column}), at), ["p"])
    return one.select(*[F.col("p")[k].alias(f"p{100 * p:g}".replace(".", "_")) for k, p in enumerate(at)])


def histogram(cloud: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) with `bins` equal bins over the range; the last one is closed."""
    one = cloud.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    t = (F.col(column) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    at = F.least(F.floor(F.coalesce(t, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("long")
    return cloud.where(F.col(column).isNotNull()).join(F.broadcast(one)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def density_grid(cloud: DataFrame, cell: float) -> DataFrame:
    """(ix, iy, n, density) of occupied XY cells."""
    grid = cloud.groupBy(F.floor(F.col("x") / cell).alias("ix"), F.floor(F.col("y") / cell).alias("iy")).agg(F.count("*").alias("n"))
    return grid.withColumn("density", F.col("n") / (cell * cell))


def distance_and_height(vertices: DataFrame, order: str = "ord") -> DataFrame:
    """(distance, height) between the first two picked points."""
    two = vertices.orderBy(order).limit(2).agg(*[F.min_by(c, order).alias(f"a{c}") for c in "xyz"], *[F.max_by(c, order).alias(f"b{c}") for c in "xyz"])
    d = [F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]
    return two.select(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("distance"), F.abs(d[2]).alias("height"))


def polygon_areas(vertices: DataFrame, by: str, order: str = "ord") -> DataFrame:
    """(by, n, length, area): polyline length and shoelace area on the footprint; the area of fewer than three vertices is 0."""
    w = Window.partitionBy(by).orderBy(order)
    ahead = vertices.withColumns({f"n{c}": F.lead(c).over(w) for c in "xyz"} | {f"f{c}": F.first(c).over(w) for c in "xy"})
    dx, dy, dz = (F.col(f"n{c}") - F.col(c) for c in "xyz")
    nx, ny = F.coalesce("nx", "fx"), F.coalesce("ny", "fy")
    return ahead.groupBy(by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.sqrt(dx * dx + dy * dy + dz * dz)), F.lit(0.0)).alias("length"),
        F.when(F.count("*") >= 3, F.abs(F.sum(F.col("x") * ny - nx * F.col("y"))) / 2).otherwise(F.lit(0.0)).alias("area"),
    )
