"""An octree as two tables: points with the Morton code of their cell, and nodes with their counts.

The cube around the cloud is halved DEPTH times along each axis; a point's code has
three bits for each halving, so the node of a point at a depth is a prefix of its code
and a node is a range of codes. A node of more than MOST points has children; one of
fewer, or at the greatest depth, is a leaf. Counts of all depths come from the counts
of the smallest cells. Points are written in the order of codes, so ranges of codes
are ranges of files, which Parquet's statistics leave out unread.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.spatial import finite
from pointloom.scratch import stored

DEPTH, MOST = 8, 10
RANGES = 64  # of codes in one filter; more are joined over the least gaps
PAD = 0.001  # of the cube's side, so that no point is on its upper border
DIMS = ("x", "y", "z")


@dataclass
class Octree:
    """points: pid, x, y, z, code, depth of its leaf; nodes: depth, node (a code's prefix), n, leaf."""

    points: DataFrame
    nodes: DataFrame
    low: tuple[float, float, float]
    side: float
    depth: int

    def corner(self, axis: int) -> Column:
        """The lower corner of a node along an axis."""
        bits = [F.shiftleft(F.shiftright("node", 3 * b + 2 - axis).bitwiseAND(1), b) for b in range(self.depth)]
        place = bits[0]
        for b in bits[1:]:
            place = place + b
        return F.lit(self.low[axis]) + place * (F.lit(self.side) / F.pow(F.lit(2.0), F.col("depth")))

    def width(self) -> Column:
        return F.lit(self.side) / F.pow(F.lit(2.0), F.col("depth"))


def _code(low: Sequence[float], side: float, depth: int) -> Column:
    """The Morton code of a point's smallest cell; a point on the border of two is in the lower one."""
    code = F.lit(0).cast("long")
    for axis, d in enumerate(DIMS):
        place = F.ceil((F.col(d) - F.lit(low[axis])) * ((1 << depth) / side)).cast("long") - 1
        place = F.least(F.greatest(place, F.lit(0).cast("long")), F.lit((1 << depth) - 1).cast("long"))
        for b in range(depth):
            code = code + F.shiftleft(F.shiftright(place, b).bitwiseAND(1), 3 * b + 2 - axis)
    return code


def built(cloud: DataFrame, depth: int = DEPTH, most: int = MOST) -> Octree:
    """The octree of the points with finite coordinates; an empty cloud has no nodes."""
    cloud = cloud.where(finite(*DIMS))
    ends = cloud.agg(*[f(d).alias(f"{n}{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends["lox"] is None:
        empty = cloud.select("pid", *DIMS, F.lit(0).cast("long").alias("code"), F.lit(0).alias("depth"))
        return Octree(empty, cloud.sparkSession.createDataFrame([], "depth int, node bigint, n bigint, leaf boolean"), (0.0, 0.0, 0.0), 1.0, depth)
    side = max(ends[f"hi{d}"] - ends[f"lo{d}"] for d in DIMS) + PAD
    low = tuple((ends[f"lo{d}"] + ends[f"hi{d}"]) / 2 - side / 2 for d in DIMS)
    coded = cloud.select("pid", *DIMS, _code(low, side, depth).alias("code"))
    cells = stored(coded.groupBy("code").agg(F.count("*").alias("n")), "cells")
    # a row for each depth of each occupied cell
    levels = cells.select("code", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth")).withColumn("node", F.expr(f"shiftright(code, 3 * ({depth} - depth))"))
    counts = stored(levels.groupBy("depth", "node").agg(F.sum("n").alias("n")), "levels")
    parents = counts.where(F.col("n") > most).select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    there = counts.withColumn("parent", F.shiftright("node", 3)).join(parents, ["depth", "parent"], "left_semi").select("depth", "node", "n").unionByName(counts.where("depth = 0"))
    nodes = stored(there.withColumn("leaf", (F.col("n") <= most) | (F.col("depth") == depth)), "nodes")
    # cells know the depth of their leaf: one more than the number of their ancestors that were split
    split = levels.select("code", "depth", "node").join(counts.where((F.col("n") > most) & (F.col("depth") < depth)).select("depth", "node"), ["depth", "node"])
    leaf = stored(cells.select("code").join(split.groupBy("code").agg(F.count("*").cast("int").alias("depth")), "code", "left").select("code", F.coalesce("depth", F.lit(0)).alias("depth")), "leaves")
    points = coded.join(leaf, "code").select("pid", *DIMS, "code", "depth")
    return Octree(stored(points.repartitionByRange("code").sortWithinPartitions("code"), "octree"), nodes, low, side, depth)


def _distance(tree: Octree, centre: Sequence[float], farthest: bool) -> Column:
    """Squared distance from a place to the nearest, or the farthest, point of a node's cube."""
    total = F.lit(0.0)
    for axis, c in enumerate(centre):
        low = tree.corner(axis)
        high = low + tree.width()
        gap = F.greatest(F.abs(F.lit(c) - low), F.abs(F.lit(c) - high)) if farthest else F.greatest(low - F.lit(c), F.lit(c) - high, F.lit(0.0))
        total = total + gap * gap
    return total


def code_ranges(tree: Octree, centre: Sequence[float], radius: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of codes (first, last) of the leaves that meet a sphere, most of them at the most: neighbours are joined in the cluster, and so are those with the least gaps between."""
    reach = (radius + tree.side * 1e-9) ** 2
    shift = f"3 * ({tree.depth} - depth)"
    leaves = tree.nodes.where(F.col("leaf") & (_distance(tree, centre, False) <= reach)).select(F.expr(f"shiftleft(node, {shift})").alias("first"), F.expr(f"shiftleft(node + 1, {shift}) - 1").alias("last"))
    # ranges of a coarser grid are few: at most `most` of its cells, whatever the sphere
    bits = 3 * tree.depth
    grain = F.lit(1 << max(0, bits - (most.bit_length() - 1))).cast("long")
    rows = leaves.withColumn("part", F.floor(F.col("first") / grain)).groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("first").collect()
    out: list[tuple[int, int]] = []
    for r in rows:
        if out and r["first"] <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], r["last"]))
        else:
            out.append((r["first"], r["last"]))
    return out


def within(tree: Octree, centre: Sequence[float], radius: float) -> DataFrame:
    """(pid, x, y, z, d2) of the points within radius of a place; only ranges of codes that meet the sphere are read."""
    inside = F.lit(False)
    for first, last in code_ranges(tree, centre, radius):
        inside |= F.col("code").between(first, last)
    d2 = sum((F.col(d) - c) * (F.col(d) - c) for d, c in zip(DIMS, centre, strict=True))
    return tree.points.where(inside).select("pid", *DIMS, d2.alias("d2")).where(F.col("d2") <= radius * radius)


def nearest_to(tree: Octree, centre: Sequence[float], k: int) -> DataFrame:
    """(pid, x, y, z, d2, rank): the k points nearest to a place, ties by pid. The smallest node around the place with k points bounds their distance; for places outside the cube it is the root."""
    place = [min(max(c, lo), lo + tree.side) for c, lo in zip(centre, tree.low, strict=True)]
    spark = tree.points.sparkSession
    own = spark.createDataFrame([tuple(map(float, place))], "x double, y double, z double").select(_code(tree.low, tree.side, tree.depth)).first()[0]
    around = tree.nodes.where(F.col("node") == F.expr(f"shiftright({own}L, 3 * ({tree.depth} - depth))")).where(F.col("n") >= k)
    bound = around.agg(F.min(_distance(tree, centre, True))).first()[0]
    if bound is None:  # fewer than k points
        bound = tree.nodes.where("depth = 0").agg(F.min(_distance(tree, centre, True))).first()[0] or 0.0
    near = within(tree, centre, bound**0.5 * (1 + 1e-9))
    rank = F.row_number().over(Window.orderBy("d2", "pid"))  # of k rows
    return near.orderBy("d2", "pid").limit(k).withColumn("rank", rank)


def level(tree: Octree, depth: int) -> DataFrame:
    """A level of detail: for each occupied node of a depth (node, n, pid, x, y, z), its first point by pid."""
    node = F.shiftright("code", 3 * (tree.depth - depth))
    return tree.points.groupBy(node.alias("node")).agg(F.count("*").alias("n"), F.min(F.struct("pid", *DIMS)).alias("p")).select("node", "n", "p.*")
