"""Windowed model inference with overlap voting, and instances of predicted classes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.transforms import from_minimum, las_code
from pointloom.operators.features import shape
from pointloom.operators.graph import dbscan, with_labels
from pointloom.operators.prefix import numbered
from pointloom.operators.sampling import windows
from pointloom.operators.spatial import neighbours
from pointloom.scratch import stored

Model = Callable[[np.ndarray], np.ndarray]  # (n, 4) standardised x, y, z, intensity -> (n, classes) logits


def standardised(windowed: DataFrame, columns: tuple[str, ...] = ("x", "y", "z", "intensity")) -> DataFrame:
    """Columns less their window's mean, by its population deviation plus 1e-8."""
    per = windowed.groupBy("window").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return windowed.join(per, "window").select(*[((F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-8)).alias(c) if c in columns else F.col(c) for c in windowed.columns])


def logits(windowed: DataFrame, model: Model, classes: int) -> DataFrame:
    """(pid, class, logit): the model on each window, a bounded group of points in pid order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid")
        out = np.asarray(model(frame[["x", "y", "z", "intensity"]].to_numpy(np.float32)), np.float64)
        return pd.DataFrame({"pid": np.repeat(frame["pid"].to_numpy(), classes), "class": np.tile(np.arange(classes, dtype=np.int32), len(frame)), "logit": out.ravel()})

    return standardised(windowed).groupBy("window").applyInPandas(run, "pid bigint, class int, logit double")


def votes(predicted: DataFrame) -> DataFrame:
    """(pid, class): greatest mean logit over the windows of a point, the first class among equals."""
    mean = predicted.groupBy("pid", "class").agg(F.avg("logit").alias("logit"))
    best = mean.groupBy("pid").agg(F.max(F.struct("logit", (-F.col("class")).alias("back"))).alias("b"))
    return best.select("pid", (-F.col("b.back")).cast("int").alias("class"))


class RandomFeatures:
    """A stand-in model with seeded random weights, for trying the pipeline out; it has learnt nothing."""

    def __init__(self, classes: int = 6, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w1, self.w2 = rng.normal(size=(4, 32)), rng.normal(size=(32, classes))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1, 0) @ self.w2


def infer(cloud: DataFrame, model: Model, classes: int = 6, size: int = 40_960, overlap: int = 2_048) -> DataFrame:
    """The cloud with las_code, tree_id and building_id (0 for none)."""
    n = cloud.count()
    local = from_minimum(cloud).withColumn("intensity", F.coalesce("intensity", F.lit(0.0))) if "intensity" in cloud.columns else from_minimum(cloud).withColumn("intensity", F.lit(0.0))
    picked = votes(logits(windows(local.select("pid", "x", "y", "z", "intensity"), n, size, overlap), model, classes))
    coded = stored(cloud.join(picked, "pid").withColumn("las_code", las_code(F.col("class"), classes)).drop("class"), "coded")
    trees, buildings = tree_layers(coded.where("las_code = 5")), building_instances(coded.where("las_code = 6"))
    ids = coded.join(trees, "pid", "left").join(buildings, "pid", "left")
    return ids.fillna(0, ["tree_id", "building_id"])


def tree_layers(trees: DataFrame, least: int = 10, max_height: float = 80.0, layer: float = 0.6, eps: float = 1.5, reach: float = 2.0) -> DataFrame:
    """(pid, tree_id): clusters of thin height layers, each hung on the nearest cluster of the layer above within reach.

    A cluster has one parent at most, so trees are the components of that forest
    and no layer waits for another. Ids count from the top layer down, by first pid.
    """
    floor = trees.agg(F.min("z").alias("z0"))
    t = trees.join(F.broadcast(floor)).where(F.col("z") - F.col("z0") <= max_height)
    top = t.agg(F.max("z").alias("z1"))
    last = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("z1") - F.col("z0")) / layer)) - 1
    t = t.join(F.broadcast(top)).withColumn("layer", F.least(last, F.floor((F.col("z") - F.col("z0")) / layer)))
    full = t.groupBy("layer").agg(F.count("*").alias("k")).where("k >= 3")
    t = stored(t.join(F.broadcast(full.select("layer")), "layer").select("pid", "x", "y", "layer"), "layers")
    labels = dbscan(t, eps, 3, ("x", "y"), ("layer",)).where("cluster >= 0")
    sizes = labels.groupBy("layer", "cluster").agg(F.count("*").alias("k")).where("k >= 3")
    members = stored(labels.join(sizes, ["layer", "cluster"]), "members")
    means = stored(members.join(t.select("pid", "x", "y"), "pid").groupBy("layer", F.col("cluster").alias("pid")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "means")
    above = means.withColumn("layer", F.col("layer") - 1)
    links = neighbours(means, above, reach, ("x", "y"), ("layer",)).groupBy("pid").agg(F.min(F.struct("d2", "other"))["other"].alias("other"))
    comps = with_labels(means, links).select(F.col("pid").alias("cluster"), F.col("comp").alias("tree"))
    whole = members.join(comps, "cluster")
    first = whole.groupBy("tree").agg(F.count("*").alias("n"), F.max("layer").alias("top")).where(F.col("n") >= least)
    order = whole.join(first, "tree").where(F.col("layer") == F.col("top")).groupBy("tree", "top").agg(F.min("cluster").alias("first"))
    ids = numbered(order.withColumn("down", -F.col("top")), ["down", "first"], "tree_id")
    return whole.join(ids, "tree").select("pid", "tree_id")


def normal_bin(step: float = 15.0) -> Column:
    """Direction bin of the columns nx, ny, nz."""
    theta = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("nz")))))
    phi = F.pmod(F.degrees(F.atan2(F.col("ny"), F.col("nx") + 1e-12)), F.lit(360.0))
    around = int(-(-360 // step))
    return F.least(F.floor(theta / step), F.lit(int(-(-90 // step)))) * around + F.pmod(F.floor(phi / step), F.lit(around))


def building_instances(buildings: DataFrame, least: int = 20, k: int = 20, step: float = 15.0, eps: float = 2.0, merge: float = 1.0) -> DataFrame:
    """(pid, building_id): clusters of points with alike normals, joined where centres are within merge and mean normals within twice the bin."""
    normals = shape(buildings, k, ("x", "y", "z")).select("pid", "nx", "ny", "nz")
    points = stored(buildings.select("pid", "x", "y", "z").join(normals, "pid").withColumn("bin", normal_bin(step)), "normals")
    labels = dbscan(points, eps, 5, ("x", "y"), ("bin",)).where("cluster >= 0")
    sizes = labels.groupBy("bin", "cluster").agg(F.count("*").alias("k")).where("k >= 3")
    members = stored(labels.join(sizes, ["bin", "cluster"]).join(points.select("pid", "x", "y", "nx", "ny", "nz"), "pid"), "members")
    means = stored(members.groupBy(F.col("cluster").alias("pid")).agg(*[F.avg(c).alias(c) for c in ("x", "y", "nx", "ny", "nz")]), "means")
    named = lambda p, key: means.select(F.col("pid").alias(key), *[F.col(c).alias(p + c) for c in ("nx", "ny", "nz")])
    near = neighbours(means, means, merge, ("x", "y")).where("pid < other").join(named("a", "pid"), "pid").join(named("b", "other"), "other")
    dot = F.col("anx") * F.col("bnx") + F.col("any") * F.col("bny") + F.col("anz") * F.col("bnz")
    norm = lambda p: F.greatest(F.lit(1e-8), F.sqrt(F.col(f"{p}nx") * F.col(f"{p}nx") + F.col(f"{p}ny") * F.col(f"{p}ny") + F.col(f"{p}nz") * F.col(f"{p}nz")))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot / (norm("a") * norm("b"))))))
    comps = with_labels(means, near.where(angle <= 2 * step).select("pid", "other")).select(F.col("pid").alias("cluster"), F.col("comp").alias("building"))
    whole = members.join(comps, "cluster")
    ids = whole.groupBy("building").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ids = numbered(ids, ["building"], "building_id")
    return whole.join(ids, "building").select("pid", "building_id")


def summary(coded: DataFrame) -> DataFrame:
    """(las_code, points, trees, buildings) per code."""
    some = lambda c: F.count_distinct(F.when(F.col(c) > 0, F.col(c)))
    return coded.groupBy("las_code").agg(F.count("*").alias("points"), some("tree_id").alias("trees"), some("building_id").alias("buildings"))


def expanded(coded: DataFrame) -> DataFrame:
    """(kind, id, pid): a row per point and output: its class, its tree and its building."""
    kinds = [F.struct(F.lit("class").alias("kind"), F.col("las_code").cast("long").alias("id")), *[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").cast("long").alias("id")) for k in ("tree", "building")]]
    return coded.select("pid", F.inline(F.array(*kinds))).where("kind = 'class' OR id > 0").select("kind", "id", "pid")
