"""Rule-based classification and instances of each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.transforms import unit_height, unit_intensity
from pointloom.operators.graph import dbscan, dense_ids, eps_components, with_labels
from pointloom.operators.prefix import named, one_row, quantiles
from pointloom.operators.spatial import finite
from pointloom.operators.stats import extent_spacing
from pointloom.schema import PLANE_CLUSTERS, SPACE_CLUSTERS
from pointloom.scratch import stored


def clustered(cloud: DataFrame, eps: float, least: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """(pid, *by, comp, size): components of points within eps in the plane, those of at least `least` points."""
    labels = stored(eps_components(cloud, eps, ("x", "y"), by), "clusters")
    sizes = labels.groupBy("comp").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return labels.join(sizes, "comp")


def grid_clustered(cloud: DataFrame, eps: float, least: int = 2) -> DataFrame:
    """(pid, comp, size): components of occupied cells that touch, corners included. Only cells are joined, as many as the occupied area has."""
    cells = cloud.select("pid", F.floor(F.col("x") / eps).alias("ix"), F.floor(F.col("y") / eps).alias("iy"))
    occupied = stored(cells.groupBy("ix", "iy").agg(F.min("pid").alias("pid")), "cells")
    ahead = occupied.select(F.col("pid").alias("other"), F.explode(F.array(*[F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("c")).select("other", "c.*")
    edges = occupied.hint("merge").join(ahead, ["ix", "iy"]).where("pid <> other").select("pid", "other")
    comps = with_labels(occupied, edges)
    labels = cells.join(occupied.withColumnRenamed("pid", "cell").join(comps.withColumnRenamed("pid", "cell"), "cell"), ["ix", "iy"]).select("pid", "comp")
    sizes = labels.groupBy("comp").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return labels.join(sizes, "comp")


def cluster_extents(points: DataFrame, cluster: str = "comp") -> DataFrame:
    """(cluster, n, x_ext, y_ext, z_ext, height): height is the highest z, clouds being height-normalised."""
    return points.groupBy(cluster).agg(F.count("*").alias("n"), *[(F.max(d) - F.min(d)).alias(f"{d}_ext") for d in "xyz"], F.max("z").alias("height"))


def cluster_rule() -> Column:
    """Category of a cluster by its extent in the plane and its height."""
    wide, h = F.greatest("x_ext", "y_ext"), F.col("height")
    return (
        F.when((wide < 0.8) & (h < 1.2), "low_vegetation")
        .when((wide <= 5.0) & (h > 1.0), "tree")
        .when((wide <= 5.0) & (h > 0.3), "low_vegetation")
        .when(wide > 5.0, "building")
        .otherwise("other")
    )


def point_rule() -> Column:
    """Category of a point outside all clusters, by its height."""
    return F.when(F.col("z") < 0.5, "low_vegetation").when(F.col("z") > 3.0, "building").when(F.col("z") > 0.5, "tree").otherwise("other")


def cluster_eps(cloud: DataFrame) -> float:
    """Six spacings by area, from 0.3 to 1.2."""
    s = extent_spacing(cloud).first()["by_area"]
    return min(1.2, max(0.3, 6 * (s or 0.05)))


def derived_parameters(cloud: DataFrame) -> DataFrame:
    """One row of what the extent of a cloud says: spacing, radius and least points of its clusters for the geometric and the intensity mode, neighbours of its features, and cluster_eps()."""
    s, a = F.col("by_extent"), F.col("by_area")
    whole = lambda x: F.floor(x).cast("long")
    between = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    return extent_spacing(cloud).select(
        s.alias("spacing"), F.greatest(F.lit(0.3), 15 * s).alias("eps"), F.greatest(F.lit(3).cast("long"), whole(1 / (s + 1e-6))).alias("least"), between(whole(1 / s), 10, 30).cast("long").alias("k"),
        F.greatest(F.lit(0.2), 8 * s).alias("intensity_eps"), F.greatest(F.lit(3).cast("long"), whole(1.5 / (s + 1e-6))).alias("intensity_least"), between(6 * a, 0.3, 1.2).alias("cluster_eps"),
    )


def geometric_labels(cloud: DataFrame, eps: float | None = None) -> DataFrame:
    """The finite points with a column category."""
    points = cloud.where(finite("x", "y", "z"))
    clusters = stored(clustered(points, eps or cluster_eps(points)), "clusters")
    rules = cluster_extents(points.join(clusters, "pid")).select("comp", cluster_rule().alias("__rule"))
    of_point = clusters.select("pid", "comp").join(rules, "comp").select("pid", "__rule")
    return points.join(of_point, "pid", "left").withColumn("category", F.coalesce("__rule", point_rule())).drop("__rule")


def intensity_thresholds(cloud: DataFrame) -> DataFrame:
    """One row of percentiles of the columns ni and nz: i5 ... i95, z5 ... z50."""
    i, z = (5, 10, 20, 30, 50, 60, 70, 85, 95), (5, 10, 20, 30, 40, 50)
    every = sorted({*i, *z})
    one = one_row(quantiles(named(cloud, {"i": F.col("ni"), "z": F.col("nz")}), [p / 100 for p in every]), ["i", "z"])
    return one.select(*[F.col(c)[every.index(p)].alias(f"{c}{p}") for c, ps in (("i", i), ("z", z)) for p in ps])


def intensity_rule() -> Column:
    """Category by intensity and height, both 0..1, and the thresholds: first match of the cascade, then by height alone; of those last rules the later ones prevail."""
    i, z, c = F.col("ni"), F.col("nz"), F.col
    return (
        F.when((z < c("z20")) & (i < c("i30")), "ground")
        .when((z >= c("z5")) & (z < c("z40")) & (i >= c("i5")) & (i < c("i50")), "low_vegetation")
        .when((z >= c("z40")) & (i >= c("i60")), "building")
        .when((z >= c("z20")) & (i >= c("i20")) & (i < c("i85")), "tree")
        .when(i >= c("i95"), "high_reflectivity")
        .when(z >= c("z20"), "tree")
        .when((z >= c("z5")) & (z < c("z20")), "low_vegetation")
        .when(z < c("z20"), "ground")
        .otherwise("other")
    )


def intensity_labels(cloud: DataFrame) -> DataFrame:
    """The finite points with ni, nz and a column category. The hybrid mode is the same."""
    points = unit_height(unit_intensity(cloud.where(finite("x", "y", "z", "intensity"))))
    thresholds = F.broadcast(intensity_thresholds(points))
    names = thresholds.columns
    return points.join(thresholds).withColumn("category", intensity_rule()).drop(*names)


def instances(labelled: DataFrame, space: bool = True, clusters: dict[str, tuple[float, int]] | None = None) -> DataFrame:
    """(pid, category, instance_id): DBSCAN per category, in space or in the plane; ids count from 1 by first pid.

    Categories of under three points have no instances, those of fewer than their
    least points are one instance. Clusters below the least points are dropped,
    not made noise. Noise of at least the least points is one more instance;
    less noise is dropped in space, and joins the largest instance in the plane,
    where ground is one instance as a whole.
    """
    table = clusters or (SPACE_CLUSTERS if space else PLANE_CLUSTERS)
    dims = ("x", "y", "z") if space else ("x", "y")
    spark = labelled.sparkSession
    config = spark.createDataFrame([(k, e, n if space else max(3, n)) for k, (e, n) in table.items()], "category string, eps double, least int")
    points = labelled.select("pid", "x", "y", "z", "category").join(F.broadcast(config), "category")
    total = points.groupBy("category").agg(F.count("*").alias("total")).where("total >= 3")
    points = stored(points.join(F.broadcast(total), "category"), "classes")
    whole = F.col("total") < F.col("least")
    if not space:
        whole |= F.col("category") == "ground"
    single = points.where(whole).select("pid", "category", F.lit(1).alias("instance_id"))
    labels = stored(dbscan(points.where(~whole), F.col("eps"), F.col("least"), dims, ("category", "eps", "least")), "dbscan")
    sizes = labels.groupBy("category", "cluster", "least").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("least"))
    kept = stored(dense_ids(labels.where("cluster >= 0").join(sizes, ["category", "cluster", "least"]), ("category",), "cluster"), "kept")
    per = kept.groupBy("category", "instance_id").agg(F.count("*").alias("n")).groupBy("category").agg(F.max("instance_id").alias("last"), F.max(F.struct("n", (-F.col("instance_id")).alias("back")))["back"].alias("largest"))
    noise = labels.where("cluster < 0").join(labels.where("cluster < 0").groupBy("category").agg(F.count("*").alias("noise")), "category").join(per, "category", "left")
    enough = F.col("noise") >= F.col("least")
    extra = F.when(enough, F.coalesce("last", F.lit(0)) + 1)
    if not space:
        extra = extra.otherwise(-F.col("largest"))
    noise = noise.select("pid", "category", extra.alias("instance_id")).where("instance_id IS NOT NULL")
    return single.unionByName(kept.select("pid", "category", "instance_id")).unionByName(noise)


def classified(cloud: DataFrame, mode: str = "geometric", eps: float | None = None) -> DataFrame:
    """(pid, category, instance_id, x, y, z): labels and instances in one of the modes geometric, intensity and hybrid; eps is that of geometric_labels()."""
    labels = stored(geometric_labels(cloud, eps) if mode == "geometric" else intensity_labels(cloud), "labels")
    return instances(labels, mode == "geometric").join(labels.select("pid", "x", "y", "z"), "pid")
