"""The octree against one that inserts points one by one, and its queries against all points."""

import numpy as np
import pytest

from pointloom.operators import octree


def inserted(points, depth=8, most=10):
    """(depth, count, leaf) of the nodes of a tree to which points are added in turn."""
    low, high = points.min(0), points.max(0)
    side = (high - low).max() + 0.001
    root = {"centre": (low + high) / 2, "side": side, "own": [], "children": None, "depth": 0}

    def child_of(node, p):
        return node["children"][int((p[0] > node["centre"][0]) * 4 + (p[1] > node["centre"][1]) * 2 + (p[2] > node["centre"][2]))]

    def insert(node, p):
        while True:
            if node["children"] is None:
                if node["depth"] >= depth or len(node["own"]) < most:
                    node["own"].append(p)
                    return
                steps = [np.array([i, j, k]) for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)]
                node["children"] = [{"centre": node["centre"] + s * node["side"] / 4, "side": node["side"] / 2, "own": [], "children": None, "depth": node["depth"] + 1} for s in steps]
                for q in node["own"]:
                    child_of(node, q)["own"].append(q)
                node["own"] = []
            node = child_of(node, p)

    for p in points:
        insert(root, p)
    out = []

    def walk(node):
        if node["children"] is None:
            out.append((node["depth"], len(node["own"]), True))
            return len(node["own"])
        n = sum(walk(c) for c in node["children"])
        out.append((node["depth"], n, False))
        return n

    walk(root)
    return sorted(x for x in out if x[1])


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(7)
    return np.concatenate([rng.normal(size=(1500, 3)) * [40, 25, 5], rng.normal(size=(500, 3)) * 0.01, np.full((40, 3), 3.0), [[900.0, 0, 0]]])


@pytest.fixture(scope="module")
def tree(spark, points):
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    return octree.built(spark.createDataFrame([*rows, (9999, float("nan"), 0.0, 0.0), (9998, None, 0.0, 0.0)], "pid bigint, x double, y double, z double").repartition(5))


def test_nodes(points, tree):
    assert sorted((r.depth, r.n, r.leaf) for r in tree.nodes.collect()) == inserted(points)
    rows = tree.points.collect()
    assert len(rows) == len(points)
    leaves = {(r.depth, r.node) for r in tree.nodes.where("leaf").collect()}
    assert {(r.depth, r.code >> 3 * (8 - r.depth)) for r in rows} == leaves


@pytest.mark.parametrize(("centre", "radius"), [((0.0, 0.0, 0.0), 0.02), ((10.0, -5.0, 1.0), 12.0), ((900.0, 1.0, 0.0), 3.0), ((-5000.0, 0.0, 0.0), 10.0), ((0.0, 0.0, 0.0), 5000.0), ((3.0, 3.0, 3.0), 0.0)])
def test_within(points, tree, centre, radius):
    d2 = ((points - np.array(centre)) ** 2).sum(1)
    assert sorted(r.pid for r in octree.within(tree, centre, radius).collect()) == np.flatnonzero(d2 <= radius * radius).tolist()


def test_ranges_leave_most_codes_out(tree):
    spans = octree.code_ranges(tree, (900.0, 1.0, 0.0), 3.0)
    assert sum(b - a + 1 for a, b in spans) < 0.2 * 8**8 and len(spans) <= octree.RANGES
    assert octree.code_ranges(tree, (-5000.0, 0.0, 0.0), 10.0) == []
    plan = octree.within(tree, (900.0, 1.0, 0.0), 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(code" in plan  # the range reaches the scan


@pytest.mark.parametrize(("centre", "k"), [((0.0, 0.0, 0.0), 5), ((30.0, 10.0, 0.0), 40), ((3.0, 3.0, 3.0), 20), ((2000.0, 50.0, 9.0), 3), ((0.0, 0.0, 0.0), 5000)])
def test_nearest(points, tree, centre, k):
    d2 = ((points - np.array(centre)) ** 2).sum(1)
    want = np.lexsort((np.arange(len(points)), d2))[:k]
    assert [r.pid for r in octree.nearest_to(tree, centre, k).orderBy("rank").collect()] == want.tolist()


def test_nothing(spark):
    tree = octree.built(spark.createDataFrame([], "pid bigint, x double, y double, z double"))
    assert tree.nodes.count() == 0 and octree.within(tree, (0.0, 0.0, 0.0), 1.0).count() == 0 and octree.nearest_to(tree, (0.0, 0.0, 0.0), 3).count() == 0
