"""Cloth, colours and layers against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import colour
from pointloom.operators import cloth, filters
from pointloom.plans import layers


def cloth_by_hand(surface, iterations, rigidness=2, step=0.65):
    """The same cloth, knot by knot."""
    nx, ny = surface.shape
    knots = [(i, j) for i in range(nx) for j in range(ny)]
    top = max((surface[k] for k in knots if not math.isnan(surface[k])), default=0.0)
    now = {k: top + 0.05 for k in knots}
    before, free = dict(now), {k: True for k in knots}
    for _ in range(iterations):
        moved = {k: now[k] + (now[k] - before[k]) * 0.99 - 0.2 * step * step if free[k] else now[k] for k in knots}
        before, now = now, moved
        for _ in range(rigidness):
            for di, dj in ((1, 0), (0, 1)):
                pull = dict.fromkeys(knots, 0.0)
                for i, j in knots:
                    a, b = (i, j), (i + di, j + dj)
                    if b in now:
                        share = 0.25 if free[a] and free[b] else 0.5
                        gap = (now[b] - now[a]) * share
                        pull[a] += gap if free[a] else 0
                        pull[b] -= gap if free[b] else 0
                now = {k: now[k] + pull[k] for k in knots}
        for k in knots:
            if not math.isnan(surface[k]) and now[k] <= surface[k]:
                now[k], free[k] = surface[k], False
        if max(abs(now[k] - before[k]) for k in knots) < 0.005:
            break
    return np.array([[now[i, j] for j in range(ny)] for i in range(nx)])


@pytest.mark.parametrize("iterations", [3, 60])
def test_cloth_against_plain_python(iterations):
    rng = np.random.default_rng(iterations)
    surface = rng.uniform(-1, 1, (9, 7))
    surface[2:4, 3:5], surface[6, 1] = -5, np.nan
    assert np.allclose(cloth.relaxed(surface, iterations), cloth_by_hand(surface, iterations), atol=1e-9)


def test_ground_under_a_box(spark, monkeypatch):
    """Even ground and a block five metres above it, over several tiles."""
    monkeypatch.setattr(cloth, "TILE", 32)
    rows = [(40 * i + j, i / 2, j / 2, 5.0 if 10 <= i < 16 and 10 <= j < 16 else 0.02 * math.sin(i + j)) for i in range(40) for j in range(40)]
    got = cloth.classified(spark.createDataFrame(rows, "pid bigint, x double, y double, z double"), iterations=100).collect()
    assert len(got) == len(rows) and all(r.is_ground == (r.z < 1) for r in got)


@pytest.mark.parametrize(("tile", "halo", "iterations"), [(32, 32, 60), (256, 64, 300)])
def test_cloth_is_one_whatever_the_tiles(spark, monkeypatch, tile, halo, iterations):
    """Sloping ground with blocks, gaps and a piece far away: the cloth of tiles is that of one array with the same knots, also where it settles between two rounds."""
    monkeypatch.setattr(cloth, "TILE", tile)
    monkeypatch.setattr(cloth, "HALO", halo)
    rng = np.random.default_rng(1)
    nx, ny = 130, 70
    height = np.add.outer(np.arange(nx) * 0.15, np.arange(ny) * 0.05) + rng.normal(size=(nx, ny)) * 0.05
    height[20:34, 10:25] += 6
    height[90:100, 40:60] += 4
    surface = -height
    surface[60:75, 20:50] = np.nan
    far = 320
    cells = [(i - 20, j - 10, float(surface[i, j])) for i in range(nx) for j in range(ny) if np.isfinite(surface[i, j])] + [(far, far, -3.0)]
    got = {(r["__ix"], r["__iy"]): r.cloth for r in cloth.heights(spark.createDataFrame(cells, "`__ix` bigint, `__iy` bigint, s double").repartition(5), iterations=iterations).collect()}
    blocks = {(x // 16 + i, y // 16 + j) for x, y, _ in cells for i in (-1, 0, 1) for j in (-1, 0, 1)}
    low = 16 * min(b for xy in blocks for b in xy)
    n = far + 32 - low
    whole, knot = np.full((n, n), np.nan), np.zeros((n, n), bool)
    for x, y, v in cells:
        whole[x - low, y - low] = v
    for x, y in blocks:
        knot[16 * x - low : 16 * x - low + 16, 16 * y - low : 16 * y - low + 16] = True
    want = cloth.relaxed(whole, iterations, knot=knot)
    assert len(got) == len(cells) and all(got[x, y] == pytest.approx(want[x - low, y - low], abs=1e-9) for x, y, _ in cells)


def test_tint(spark):
    df = spark.createDataFrame([(0.2, 0.5, 1.0, 3), (0.0, 0.99, 0.4, 40)], "r double, g double, b double, k int")
    got = df.select("r", "g", "b", "k", colour.tinted(F.struct("r", "g", "b"), F.col("k"), 0.05).alias("c")).collect()
    for row in got:
        wave = 1 + 0.03 * math.sin(0.1 * row.k)
        assert [row.c[x] for x in "rgb"] == pytest.approx([min(1.0, max(0.0, row[x] * wave + 0.05)) for x in "rgb"])


def test_layers(spark):
    """Removal takes a folder with all below it; a folder that is its own ancestor ends the walk."""
    folders = spark.createDataFrame([(1, None, True), (2, 1, True), (3, 2, False), (4, None, True), (5, 6, True), (6, 5, True)], "id bigint, parent bigint, visible boolean")
    rows = spark.createDataFrame([(10, 1, True, 2), (11, 3, True, 5), (12, 4, True, 6), (13, 4, False, 6), (14, 2, True, 5)], "layer bigint, folder bigint, visible boolean, las_code int")
    ids = lambda df, c: sorted(r[c] for r in df.collect())
    assert ids(layers.descendants(folders, 1), "id") == [1, 2, 3] and ids(layers.descendants(folders, 5), "id") == [5, 6] and ids(layers.descendants(folders, 9), "id") == []
    left, kept = layers.without_folder(rows, folders, 2)
    assert ids(left, "layer") == [10, 12, 13] and ids(kept, "id") == [1, 4, 5, 6]
    assert ids(layers.visible(rows, folders), "layer") == [10, 12, 14] and ids(layers.visible(rows, folders, [5]), "layer") == [14]


def test_split_check(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 5.0)], "pid bigint, x double")
    assert not filters.check_split(df, F.col("x") < 2)
    assert filters.check_split(df, F.col("x") < 9) and filters.check_split(df, F.col("x") < 0)
