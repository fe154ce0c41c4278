"""Neighbour joins on a hash grid.

Points fall into cells as wide as the search radius. One side of the join is
copied to the neighbouring cells, the other stays; both meet by an equi-join on
the cell and an exact test of the distance. Cells hold about as many points as a
neighbourhood, judged by the cells that have points, so work grows with the points.
A crowded cell is one join key; AQE splits it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.scratch import stored

BLOCK = 1 << 14  # points of a cell that a task holds at once
TILE = 256, 1024  # points that are compared at once


def finite(*cols: str) -> Column:
    """No null, NaN or infinity among the columns."""
    test = F.lit(True)
    for c in cols:
        test &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return test


def square_distance(a: str, b: str, dims: Sequence[str]) -> Column:
    total = None
    for d in dims:
        step = F.col(f"{a}{d}") - F.col(f"{b}{d}")
        total = step * step if total is None else total + step * step
    return total


def _cells(df: DataFrame, dims: Sequence[str], width: Column, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}c{k}": F.floor(F.col(f"{prefix}{d}") / width) for k, d in enumerate(dims)})


def neighbours(left: DataFrame, right: DataFrame, radius: float | Column, dims: Sequence[str] = ("x", "y"), by: Sequence[str] = (), copy_left: bool = False, cells: bool = False) -> DataFrame:
    """(pid, other, d2), with `by` and, if asked for, the left point's cell c0, c1, ..., for all left and right points within radius of one another, a point and itself included if it is on both sides.

    The right side is copied to the cells around its points, or the left one: the smaller should be.

    Sides need pid, the dims and, to join only equal values, the columns `by`. A radius
    that is a column must follow from those: points that meet have the same. Neither
    side is broadcast: Spark judges the copied one by its size before it is copied.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    a = left.select(F.col("pid"), *[F.col(d).alias(f"a_{d}") for d in dims], r.alias("a_r"), *by)
    b = right.select(F.col("pid").alias("other"), *[F.col(d).alias(f"b_{d}") for d in dims], r.alias("b_r"), *by)
    a, b = _cells(a, dims, F.col("a_r"), "a_"), _cells(b, dims, F.col("b_r"), "b_")
    spread = lambda df, c: df.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    for k in range(len(dims)):
        a, b = (spread(a, f"a_c{k}"), b) if copy_left else (a, spread(b, f"b_c{k}"))
    keys = [F.col(f"a_c{k}") == F.col(f"b_c{k}") for k in range(len(dims))]
    on = keys[0]
    for k in keys[1:]:
        on &= k
    for c in by:
        on &= a[c].eqNullSafe(b[c])
    d2 = square_distance("a_", "b_", dims)
    joined = a.hint("merge").join(b, on & (d2 <= F.col("a_r") * F.col("a_r")))
    return joined.select("pid", "other", d2.alias("d2"), *[a[c] for c in by], *[F.col(f"a_c{k}").alias(f"c{k}") for k in range(len(dims) if cells else 0)])


def radius_counts(cloud: DataFrame, radius: float, dims: Sequence[str] = ("x", "y"), by: Sequence[str] = ()) -> DataFrame:
    """(pid, n): neighbours within radius, the point itself included."""
    return neighbours(cloud, cloud, radius, dims, by).groupBy("pid").agg(F.count("*").alias("n"))


def good_radius(cloud: DataFrame, k: int, dims: Sequence[str], halvings: int = 24) -> float:
    """A cell width for k neighbours: the extent gives one for evenly spread points, which is halved until an occupied cell has about k points, so that a far outlier doesn't put all others into one cell; any width is correct."""
    spans = cloud.agg(F.count("*").alias("n"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    full = {d: spans[d] for d in dims if spans[d] and spans[d] > 0}
    if not spans["n"] or not full:
        return 1.0
    volume = 1.0
    for s in full.values():
        volume *= s
    widest = max((volume * k / spans["n"]) ** (1 / len(full)), max(full.values()) * 1e-6)
    widths = [widest / 2**j for j in range(halvings)]
    cell = lambda w: F.xxhash64(*[F.floor(F.col(d) / w) for d in full])
    occupied = cloud.agg(*[F.approx_count_distinct(cell(w)).alias(f"w{j}") for j, w in enumerate(widths)]).first()
    most = max(occupied)
    # points that coincide are in one cell at any width
    return next(w for w, cells in zip(widths, occupied, strict=True) if cells * 2 * k >= spans["n"] or cells >= 0.9 * most)


def nearest(left: DataFrame, right: DataFrame, k: int, dims: Sequence[str] = ("x", "y"), radius: float | None = None, skip_self: bool = False) -> DataFrame:
    """(pid, other, d2, rank): the exact k nearest right points of each left point, ties by other's pid; fewer only if right has fewer.

    A point is certain once it has k neighbours within the search radius; the
    others go on with twice the radius, so each round has only what is left.
    Of a cloud and itself, the first round copies the right side, so that all that a
    point meets is in one cell and is ranked where it was joined, without a shuffle;
    the later ones copy the few points that are left.
    """
    need = k
    r = radius or good_radius(right, k, dims)
    reach = right.select(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    seen = left.select(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if any(x is None for x in (*reach, *seen)):
        return left.sparkSession.createDataFrame([], "pid bigint, other bigint, d2 double, rank int")
    across = sum((max(reach[f"hi_{d}"], seen[f"hi_{d}"]) - min(reach[f"lo_{d}"], seen[f"lo_{d}"])) ** 2 for d in dims) ** 0.5
    todo, done = left.select("pid", *dims), None
    while True:
        at_home = left is right and done is None
        near = neighbours(todo, right, r, dims, copy_left=not at_home, cells=at_home)
        if skip_self:
            near = near.where("pid <> other")
        rank = F.row_number().over(Window.partitionBy(*(f"c{k}" for k in range(len(dims) if at_home else 0)), "pid").orderBy("d2", "other"))
        best = near.withColumn("rank", rank).where(F.col("rank") <= need).select("pid", "other", "d2", "rank")
        last = r > across
        if last:
            part = best
        else:
            best = stored(best, "nearest")
            full = best.groupBy("pid").agg(F.max("rank").alias("n")).where(F.col("n") >= need).select("pid")
            part = best.join(full, "pid", "left_semi")
        part = part.select("pid", "other", "d2", "rank")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        todo = stored(todo.join(full, "pid", "left_anti"), "uncertain")
        if todo.isEmpty():
            return done
        r *= 2


class Block(Protocol):
    """What is made of the points of a block (an array for each column) as others pass by."""

    def meet(self, other: dict[str, np.ndarray]) -> pa.RecordBatch | None: ...

    def result(self) -> pa.RecordBatch | None: ...


def in_blocks(cloud: DataFrame, radius: float, columns: Sequence[str], block: Callable[[dict[str, np.ndarray]], Block], schema: str, ahead: bool = False) -> DataFrame:
    """What blocks make of the points in their cell and the 26 around, or, if ahead, in theirs and 13 of those, so that each pair of cells meets once.

    For work on all pairs within radius in space that needs no table of them: a cell's points are dealt into blocks of
    about BLOCK, a task holds one block at a time, and the others are sorted behind it and pass a batch at a time.
    So no task holds more at any density. cloud has pid, x, y, z and the columns, finite ones.
    """
    dims, keys = ("x", "y", "z"), ["c0", "c1", "c2"]
    names = ["pid", *dims, *columns]
    points = stored(cloud.where(finite(*dims)).select(*names, *[F.floor(F.col(d) / float(radius)).alias(k) for d, k in zip(dims, keys, strict=True)]), "cells")
    cells = stored(points.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if not ahead or (i, j, k) >= (0, 0, 0)]
    step = F.explode(F.array(*[F.struct(*[F.lit(x).alias(k) for x, k in zip(o, keys, strict=True)]) for o in steps]))
    own = points.join(cells, keys).select(*names, *keys, F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"))
    copies = points.withColumn("o", step).select(*names, *[(F.col(k) - F.col(f"o.{k}")).alias(k) for k in keys])
    others = copies.hint("merge").join(cells, keys).select(*names, *keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, now = None, [], None
        for batch in batches:
            key = np.column_stack([batch.column(k).to_numpy() for k in (*keys, "block", "side")])
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part, place = {c: batch.column(c).to_numpy()[a:b] for c in names}, tuple(key[a, :4]) if b > a else at
                if place != at and now is not None and (out := now.result()) is not None:
                    yield out
                at, parts, now = (at, parts, now) if place == at else (place, [], None)
                if b > a and not key[a, 4]:
                    parts.append(part)
                elif b > a:
                    now = now or block({c: np.concatenate([x[c] for x in parts]) for c in names})
                    if (out := now.meet(part)) is not None:
                        yield out
        if now is not None and (out := now.result()) is not None:
            yield out

    return own.unionByName(others).repartition(*keys, "block").sortWithinPartitions(*keys, "block", "side").mapInArrow(run, schema)


def tiles(own: dict[str, np.ndarray], other: dict[str, np.ndarray], r: float) -> Iterator[tuple[slice, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(rows of own, places in other, their offsets by dimension, whether they are within r), TILE at a time; own should be sorted by place."""
    dims = ("x", "y", "z")
    for first in range(0, len(own["pid"]), TILE[0]):
        rows = slice(first, first + TILE[0])
        near = np.ones(len(other["pid"]), bool)
        for d in dims:  # a little more, for what rounding does
            near &= (other[d] >= own[d][rows].min() - r * (1 + 1e-9)) & (other[d] <= own[d][rows].max() + r * (1 + 1e-9))
        found = np.flatnonzero(near)
        for k in range(0, len(found), TILE[1]):
            places = found[k : k + TILE[1]]
            steps = [other[d][places] - own[d][rows, None] for d in dims]
            yield rows, places, steps, steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2] <= r * r


def by_place(points: dict[str, np.ndarray], r: float) -> dict[str, np.ndarray]:
    """The points sorted by cells half as wide as r."""
    order = np.lexsort([np.floor(points[d] * (2 / r)) for d in ("x", "y", "z")])
    return {c: v[order] for c, v in points.items()}
