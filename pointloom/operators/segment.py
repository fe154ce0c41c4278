"""Single trees and buildings.

Both are greedy: candidates are visited in the order of their first point and
take points that earlier ones left. Here candidates that share no point run
together: in each round those go that have no earlier unfinished candidate to
share points with, which gives the sequential result in as many rounds as the
longest chain of conflicts, each round a few joins over all candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.classify import clustered
from pointloom.operators.features import mean_offsets, shape
from pointloom.operators.filters import building_candidate, trunk_height
from pointloom.operators.graph import component_of, with_labels
from pointloom.operators.prefix import numbered, quantiles
from pointloom.operators.spatial import by_place, in_blocks, neighbours, tiles
from pointloom.operators.stats import spacing
from pointloom.scratch import stored

TREES = {"min_tree_spacing": 0.5, "max_crown_width": 1.5, "min_tree_height": 1.0, "max_tree_height": 30.0, "enforce_max_height": False}
BUILDINGS = {"min_building_height": 2.0, "max_building_height": 100.0, "min_building_area": 4.0, "building_eps": 1.5, "roof_flatness_threshold": 0.7}


def given(defaults: Mapping, params: Mapping) -> dict:
    """Parameters over defaults, each of its default's kind; unknown names are refused."""
    if unknown := set(params) - set(defaults) - {"point_spacing"}:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    return dict(defaults) | {k: type(defaults.get(k, 0.0))(v) for k, v in params.items()}


def in_rounds(claims: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(pid, rank) for all points taken. claims: (rank, pid), all that a candidate may take.

    step(ready, taken) gets the (rank) that go now and the (pid, rank) taken so far, and returns the (pid, rank) that they take.
    """
    spark = claims.sparkSession
    claims = stored(claims.select("rank", "pid").distinct(), "claims")
    pairs = stored(claims.withColumnRenamed("rank", "early").join(claims, "pid").where("early < rank").select("early", "rank").distinct(), "conflicts")
    todo = stored(claims.select("rank").distinct(), "todo")
    taken = spark.createDataFrame([], "pid bigint, rank bigint")
    while not todo.isEmpty():
        blocked = pairs.join(todo.withColumnRenamed("rank", "early"), "early", "left_semi").select("rank").distinct()
        ready = stored(todo.join(blocked, "rank", "left_anti"), "ready")
        taken = stored(taken.unionByName(step(ready, taken).select("pid", "rank")), "taken")
        todo = stored(todo.join(ready, "rank", "left_anti"), "todo")
    return taken


def _columns(points: DataFrame, s: float, relaxed: bool) -> DataFrame:
    """(pid): lower parts of vertical columns, components of height-filtered points that are tall enough."""
    high = points.where(trunk_height(s, relaxed=relaxed))
    comps = clustered(high, max(4 * s, 0.3) if relaxed else max(3 * s, 0.15), 10 if relaxed else 8).join(points.select("pid", "z"), "pid")
    tall = comps.groupBy("comp").agg(F.min("z").alias("low"), F.max("z").alias("top")).where(F.col("top") - F.col("low") > (1.5 if relaxed else 1.0))
    inside = comps.join(tall, "comp")
    if relaxed:
        return inside.select("pid")
    inside = inside.where(F.col("z") <= F.col("low") + 0.6 * (F.col("top") - F.col("low")))
    enough = inside.groupBy("comp").agg(F.count("*").alias("k")).where("k >= 3")
    return inside.join(enough, "comp", "left_semi").select("pid")


def trunks(points: DataFrame, s: float, min_tree_spacing: float) -> DataFrame:
    """(pid, rank): trunk points, trunks numbered by first point; trunks whose centres are closer than min_tree_spacing are one."""
    found = stored(_columns(points, s, False), "trunk_points")
    if found.count() < 5:
        found = stored(_columns(points, s, True), "trunk_points")
    parts = stored(clustered(points.join(found, "pid", "left_semi"), max(min_tree_spacing, 3 * s)).join(points.select("pid", "x", "y"), "pid"), "trunks")
    centres = stored(parts.groupBy("comp").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumnRenamed("comp", "pid"), "centres")
    close = neighbours(centres, centres, min_tree_spacing, ("x", "y")).where((F.col("pid") < F.col("other")) & (F.col("d2") < min_tree_spacing * min_tree_spacing))
    merged = parts.join(with_labels(centres, close).select(F.col("pid").alias("comp"), F.col("comp").alias("trunk")), "comp")
    sizes = merged.groupBy("trunk").agg(F.count("*").alias("k")).where(F.col("k") >= max(5, int(10 * s)))
    ranks = numbered(sizes, ["trunk"], "rank")
    return merged.join(ranks, "trunk").select("pid", "rank")


def segment_trees(cloud: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    """(pid, tree_id) of all points, 0 for none, and one row of metrics per tree."""
    p = given(TREES, params)
    s = float(params.get("point_spacing") or spacing(cloud).first()["spacing"] or 0.05)
    points = stored(cloud.select("pid", "x", "y", "z"), "points")
    trunk = stored(trunks(points, s, p["min_tree_spacing"]), "trunks")
    shapes = trunk.join(points, "pid").groupBy("rank").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("z").alias("base"), F.max("z").alias("top"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("ext"))
    r = F.least(F.greatest(3 * F.col("ext"), F.lit(6 * s), F.lit(0.8 * p["min_tree_spacing"])), F.lit(2 * p["max_crown_width"]))
    shapes = stored(shapes.withColumn("r", r), "shapes")
    top, z = F.col("top"), F.col("z")
    near = neighbours(shapes.select(F.col("rank").alias("pid"), "x", "y"), points, 3 * p["max_crown_width"], ("x", "y"), copy_left=True)
    crown = near.select(F.col("pid").alias("rank"), F.col("other").alias("pid"), F.sqrt("d2").alias("d")).join(shapes.select("rank", "top", "r"), "rank").join(points, "pid")
    roof = top + 1.5 * F.col("r")
    crown = crown.withColumn("inner", (F.col("d") < F.col("r")) & (z > top - 0.1) & (z <= roof + 0.5))
    crown = stored(crown.withColumn("outer", (F.col("d") < 1.5 * F.col("r")) & (z > top - 0.2) & (z <= roof + 1.0)).where("inner OR outer").select("rank", "pid", "x", "y", "z", "inner", "outer"), "crowns")

    def step(ready: DataFrame, taken: DataFrame) -> DataFrame:
        free = crown.join(ready, "rank", "left_semi").join(taken.select("pid"), "pid", "left_anti")
        hits = free.groupBy("rank").agg(F.count_if("inner").alias("hits"))
        free = free.join(hits, "rank").where(F.when(F.col("hits") < 5, F.col("outer")).otherwise(F.col("inner")))
        free = stored(free.join(free.groupBy("rank").agg(F.count("*").alias("all")), "rank"), "free")
        # a point of two crowns in one round would be a conflict, so pids are apart here
        comps = stored(clustered(free.where("all > 5"), 3 * s, by=("rank",)).select("rank", "comp", "pid"), "crown_parts")
        largest = comps.groupBy("rank", "comp").agg(F.count("*").alias("size")).groupBy("rank").agg(F.max(F.struct("size", (-F.col("comp")).alias("back"))).alias("b"))
        best = comps.join(largest.select("rank", (-F.col("b.back")).alias("comp")), ["rank", "comp"]).select("rank", "pid").distinct()
        lone = free.where("all > 5").join(best.select("rank").distinct(), "rank", "left_anti").select("rank", "pid")
        tree = trunk.join(ready, "rank", "left_semi").select("rank", "pid").unionByName(best).unionByName(lone).unionByName(free.where("all <= 5").select("rank", "pid")).distinct()
        tree = stored(tree.join(points.select("pid", "z"), "pid"), "tree")
        height = F.max("z") - F.min("z")
        tall = tree.groupBy("rank").agg(height.alias("h")).where(F.col("h") >= 0.5 * p["min_tree_height"])
        if p["enforce_max_height"]:
            tall = tall.where(F.col("h") <= p["max_tree_height"])
        return tree.join(tall, "rank", "left_semi")

    claims = crown.select("rank", "pid").unionByName(trunk.select("rank", "pid"))
    taken = stored(in_rounds(claims, step), "trees")
    # metrics are of the points at the time; later trunks write over earlier crowns
    ids = stored(numbered(taken.select("rank").distinct(), ["rank"], "tree_id"), "ids")
    final = taken.groupBy("pid").agg(F.max("rank").alias("rank")).join(ids, "rank").select("pid", "tree_id")
    labels = points.select("pid").join(final, "pid", "left").select("pid", F.coalesce("tree_id", F.lit(0)).cast("long").alias("tree_id"))
    metrics = tree_metrics(taken.join(ids, "rank").join(points, "pid").join(shapes.select("rank", "base", "top", F.col("x").alias("cx"), F.col("y").alias("cy")), "rank"))
    return labels, metrics


def tree_metrics(rows: DataFrame) -> DataFrame:
    """One row per tree from rows of (tree_id, x, y, z, base, top, cx, cy): heights, crown and trunk shares and bounds, to 3 places."""
    above, below = F.col("z") > F.col("top"), F.col("z") <= F.col("top") + 0.1
    span = lambda c, when: F.coalesce(F.max(F.when(when, F.col(c))) - F.min(F.when(when, F.col(c))), F.lit(0.0))
    three = lambda c: F.round(c, 3)
    out = rows.groupBy("tree_id", "base", "top", "cx", "cy").agg(
        F.count("*").alias("point_count"), three(F.max("z") - F.min("z")).alias("tree_height"), three(span("z", below)).alias("trunk_height"), three(span("z", above)).alias("crown_height"),
        three(F.greatest(span("x", above), span("y", above))).alias("crown_diameter"), three(F.count_if(above) / F.count("*")).alias("crown_ratio"), F.count_if(above).alias("crown_points"),
        (F.count("*") - F.count_if(above)).alias("trunk_points"), *[three(f(c)).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))],
    )
    return out.withColumns({"label": F.concat(F.lit("Tree_"), "tree_id"), "trunk_base_z": three(F.col("base")), "trunk_top_z": three(F.col("top")), "location": F.array(three(F.col("cx")), three(F.col("cy")), three(F.col("base")))}).drop("base", "top", "cx", "cy")


def segment_buildings(cloud: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    """(pid, building_id) of all points, 0 for none, and one row of metrics per building."""
    p = given(BUILDINGS, params)
    s = float(params.get("point_spacing") or spacing(cloud).first()["spacing"] or 0.05)
    points = stored(cloud.select("pid", "x", "y", "z").join(shape(cloud, min(20, max(5, int(1 / max(s, 0.01))))).select("pid", "planarity"), "pid"), "points")
    picked = points.where(building_candidate(p["min_building_height"], p["max_building_height"], p["roof_flatness_threshold"]))
    parts = stored(clustered(picked, p["building_eps"], max(5, int(20 * s))).select("pid", "comp"), "parts")
    box = parts.join(points, "pid").groupBy("comp").agg(F.count("*").alias("size"), *[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    box = box.withColumns({"width": F.col("hix") - F.col("lox"), "depth": F.col("hiy") - F.col("loy"), "height": F.col("hiz") - F.col("loz")}).withColumn("area", F.col("width") * F.col("depth"))
    box = box.where((F.col("area") >= p["min_building_area"]) & (F.col("height") >= 0.5 * p["min_building_height"]) & (F.col("hiz") >= p["min_building_height"]))
    box = stored(numbered(box, ["comp"], "rank"), "boxes")
    own = stored(parts.join(box.select("comp", "rank"), "comp").select("pid", "rank"), "own")
    claims = stored(_within_footprints(points, box, p["building_eps"]).unionByName(own.select("rank", "pid")).distinct(), "footprints")

    def step(ready: DataFrame, taken: DataFrame) -> DataFrame:
        mine = own.join(ready, "rank", "left_semi")
        wide = claims.join(ready, "rank", "left_semi").join(taken.select("pid"), "pid", "left_anti")
        wide = stored(wide.join(_within_footprints(points, box.join(ready, "rank", "left_semi"), p["building_eps"]), ["rank", "pid"], "left_semi").join(points.select("pid", "x", "y"), "pid"), "wide")
        fits = wide.groupBy("rank").agg(F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("a")).join(box.select("rank", "size"), "rank")
        fits = fits.where((F.col("n") > F.col("size")) & (F.col("a") < 5 * p["min_building_area"])).select("rank")
        return mine.select("pid", "rank").unionByName(wide.join(fits, "rank", "left_semi").select("pid", "rank")).distinct()

    taken = stored(in_rounds(claims, step), "buildings")
    labels = points.select("pid").join(taken.groupBy("pid").agg(F.max("rank").alias("rank")), "pid", "left").select("pid", F.coalesce("rank", F.lit(0)).cast("long").alias("building_id"))
    return labels, building_metrics(taken.join(points, "pid"), box)


def _within_footprints(points: DataFrame, box: DataFrame, cell: float) -> DataFrame:
    """(rank, pid): points within each box grown by 0.3 of its longer side, half a metre down and one up. Boxes are cut into grid cells that points meet by an equi-join."""
    side = max(4 * cell, 1.0)
    grow = 0.3 * F.greatest("width", "depth")
    b = box.select("rank", (F.col("lox") - grow).alias("x0"), (F.col("hix") + grow).alias("x1"), (F.col("loy") - grow).alias("y0"), (F.col("hiy") + grow).alias("y1"), (F.col("loz") - 0.5).alias("z0"), (F.col("hiz") + 1.0).alias("z1"))
    b = b.withColumn("ix", F.explode(F.sequence(F.floor(F.col("x0") / side), F.floor(F.col("x1") / side)))).withColumn("iy", F.explode(F.sequence(F.floor(F.col("y0") / side), F.floor(F.col("y1") / side))))
    at = points.select("pid", "x", "y", "z", F.floor(F.col("x") / side).alias("ix"), F.floor(F.col("y") / side).alias("iy"))
    inside = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1")) & F.col("z").between(F.col("z0"), F.col("z1"))
    return at.hint("merge").join(b, ["ix", "iy"]).where(inside).select("rank", "pid")


def building_metrics(rows: DataFrame, box: DataFrame) -> DataFrame:
    """One row per building: size of its cluster before growth, points after it, mean planarity of the highest fifth if that has over five points."""
    tall = quantiles(rows.select(F.col("rank").alias("name"), F.col("z").alias("v")), [0.8]).select(F.col("name").alias("rank"), F.col("q")[0].alias("level"))
    level = rows.groupBy("rank").agg(F.count("*").alias("point_count")).join(tall, "rank")
    roof = rows.join(level, "rank").groupBy("rank", "point_count").agg(F.count_if(F.col("z") >= F.col("level")).alias("k"), F.avg(F.when(F.col("z") >= F.col("level"), F.col("planarity"))).alias("flat"))
    m = roof.join(box, "rank")
    three = lambda c: F.round(c, 3)
    return m.select(
        F.col("rank").alias("building_id"), F.concat(F.lit("Building_"), "rank").alias("label"), "point_count", *[three(F.col(c)).alias(c) for c in ("width", "depth", "height", "area")], three(F.col("area") * F.col("height")).alias("volume"),
        three(F.col("width") / F.greatest("depth", F.lit(0.1))).alias("aspect_ratio"), three(F.when(F.col("k") > 5, F.col("flat")).otherwise(F.lit(0.0))).alias("roof_planarity"),
        *[three(F.col(f"{a}{c}")).alias(f"{c}_{n}") for c in "xyz" for a, n in (("lo", "min"), ("hi", "max"))],
    )


def corners(box: DataFrame) -> DataFrame:
    """(building_id, corner, x, y, z): the eight corners of each building's bounds, lower four first."""
    rows = [F.struct(F.lit(k).alias("corner"), F.col(f"x_{x}").alias("x"), F.col(f"y_{y}").alias("y"), F.col(f"z_{z}").alias("z")) for k, (x, y, z) in enumerate((x, y, z) for z in ("min", "max") for x, y in (("min", "min"), ("max", "min"), ("max", "max"), ("min", "max")))]
    return box.select("building_id", F.inline(F.array(*rows)))


class _Links:
    """Edges that join whatever a block's points and those that pass by are joined to: at most one for each of these and each of the block's."""

    def __init__(self, own: dict[str, np.ndarray], r: float, angle: float):
        self.own, self.r, self.angle = by_place(own, r), r, angle
        self.label = np.arange(len(own["pid"]))  # least place of the points known to be joined

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the components of points a to those of points b, one by one."""
        a, b = self.label[a], self.label[b]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            up = np.arange(len(self.label))
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (up != (over := up[up])).any():
                up = over
            self.label, a, b = up[self.label], up[a], up[b]

    def meet(self, other: dict[str, np.ndarray]) -> pa.RecordBatch:
        link = np.full(len(other["pid"]), -1)  # a point of the block for each other
        for rows, places, _, within in tiles(self.own, other, self.r):
            product = sum(self.own[c][rows, None] * other[c][places] for c in ("nx", "ny", "nz"))
            joined = within & (np.abs(product) > self.angle)
            some = joined.any(0)
            places, joined = places[some], joined[:, some]
            first = joined.argmax(0) + rows.start
            known = link[places] >= 0
            self._join(first[known], link[places][known])
            link[places] = np.where(known, link[places], first)
            while len(places) and (own := self.label[rows]).min() < own.max():
                least = np.where(joined, own[:, None], len(self.label)).min(0)
                lower = np.minimum(own, np.where(joined, least, len(self.label)).min(1))
                if (lower == own).all():
                    break
                self._join(own, lower)
        has = np.flatnonzero((link >= 0) & (self.own["pid"][link] != other["pid"]))
        return self._edges(self.own["pid"][link[has]], other["pid"][has])

    def result(self) -> pa.RecordBatch:
        has = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self._edges(self.own["pid"][self.label[has]], self.own["pid"][has])

    @staticmethod
    def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["pid", "other"])


def region(cloud: DataFrame, seed: tuple[float, float, float], radius: float = 1.0, angle: float = 0.3) -> DataFrame:
    """(pid): the region that grows from the point nearest to the seed, over neighbours within radius in space whose normals (mean_offsets) have a product of more than `angle` in absolute value.

    It is the component of that point. Neighbours are compared in blocks, which keep as many edges as join the same points.
    """
    away = sum((F.col(d) - x) * (F.col(d) - x) for d, x in zip("xyz", seed, strict=True))
    first = cloud.select("pid", away.alias("away")).orderBy("away", "pid").first()
    points = cloud.select("pid", "x", "y", "z").join(mean_offsets(cloud, radius), "pid")
    edges = in_blocks(points, radius, ("nx", "ny", "nz"), lambda own: _Links(own, radius, angle), "pid bigint, other bigint", ahead=True)
    return component_of(with_labels(cloud, edges), first["pid"])
