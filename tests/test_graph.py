import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import classify, graph, inference, spatial


def as_cloud(spark, xyz, **more):
    rows = [(i, *map(float, p), *(int(v[i]) for v in more.values())) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "pid bigint, x double, y double, z double" + "".join(f", {c} int" for c in more)).repartition(3)


def brute_dbscan(points, eps, least):
    """Breadth first in index order."""
    near = [np.flatnonzero(((points - p) ** 2).sum(1) <= eps * eps) for p in points]
    label, k = np.full(len(points), -1), -1
    for s in range(len(points)):
        if label[s] >= 0 or len(near[s]) < least:
            continue
        k, queue = k + 1, [s]
        label[s] = k
        while queue:
            u = queue.pop(0)
            if len(near[u]) >= least:
                for v in near[u]:
                    if label[v] < 0:
                        label[v] = k
                        queue.append(v)
    return label


def partition(labels):
    groups = {}
    for i, v in enumerate(labels):
        groups.setdefault(v, set()).add(i)
    return {frozenset(g) for k, g in groups.items() if k != -1}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)]
    up = {n: n for e in edges for n in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {x.node: x.label for x in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_no_edges(spark):
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize(("seed", "dims"), [(1, ("x", "y")), (2, ("x", "y", "z"))])
def test_dbscan(spark, seed, dims):
    rng = np.random.default_rng(seed)
    xyz = np.concatenate([rng.normal(c, 0.6, (40, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 1))] + [rng.uniform(-5, 8, (30, 3))])
    want = brute_dbscan(xyz[:, : len(dims)], 0.7, 5)
    got = {r.pid: r.cluster for r in graph.dbscan(as_cloud(spark, xyz), 0.7, 5, dims).collect()}
    got = [got[i] for i in range(len(xyz))]
    assert partition(got) == partition(want) and {i for i, g in enumerate(got) if g == -1} == set(np.flatnonzero(want == -1))


def test_neighbours_and_nearest(spark):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.normal(0, 1, (80, 3)), rng.normal(30, 5, (20, 3)), np.zeros((3, 3))])
    cloud = as_cloud(spark, xyz)
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    got = {(r.pid, r.other) for r in spatial.neighbours(cloud, cloud, 1.1, ("x", "y", "z")).collect()}
    assert got == set(zip(*np.nonzero(d2 <= 1.1 * 1.1), strict=True))
    for k, radius in ((4, 0.05), (103, None)):
        rows = spatial.nearest(cloud, cloud, k, ("x", "y", "z"), radius=radius).collect()
        want = {(i, j) for i in range(len(xyz)) for j in np.lexsort((np.arange(len(xyz)), d2[i]))[:k]}
        assert {(r.pid, r.other) for r in rows} == want


def test_component_of_a_seed(spark):
    """What a walk over pairs of points reaches, without a table of pairs; coincident points count once for their cell."""
    rng = np.random.default_rng(8)
    xyz = np.concatenate([rng.uniform(0, 3, (150, 3)), np.zeros((40, 3))])
    cloud = as_cloud(spark, xyz)
    want = {r.pid for r in graph.reachable(spatial.neighbours(cloud, cloud, 0.3).where("pid < other"), 7).collect()}
    got = [r.pid for r in graph.component_of(graph.eps_components(cloud, 0.3), 7).collect()]
    assert sorted(got) == sorted(want) and [r.pid for r in graph.component_of(graph.eps_components(cloud, 0.3), 999).collect()] == [999]


def test_cells_around(spark):
    """Copies go only where eps reaches, are not sorted, and miss no pair of points, on the cells' sides and far from the origin too."""
    rng = np.random.default_rng(11)
    eps, n = 0.3, 240
    grid = eps / np.sqrt(2) * np.array([(i, j) for i in range(8) for j in range(8)])
    xy = np.concatenate([rng.uniform(-3, 3, (n, 2)), grid, grid + 1e6])
    cells = graph._Cells(as_cloud(spark, np.column_stack([xy, np.zeros(len(xy))])), eps, ("x", "y"), ())
    lo, hi = (lambda d: F.col(f"lo_{d}")), (lambda d: F.col(f"hi_{d}"))
    near = cells.around(cells.table, graph._offsets(2), lo, hi)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan and "Broadcast" not in plan
    got = {(r.rep, r.b_rep) for r in near.select("rep", "b_rep").collect()}
    rep = {r.pid: r.rep for r in cells.points.collect()}
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(2)
    assert {(rep[i], rep[j]) for i, j in zip(*np.nonzero(d2 <= eps * eps), strict=True)} <= got
    assert {len(r.outer) for r in cells.table.where("n = 1").collect()} == {1}


def test_copied_sides_are_not_broadcast(spark, tmp_path):
    """A side that is copied to many cells is small before, and would go through the driver."""
    rng = np.random.default_rng(5)
    as_cloud(spark, rng.uniform(0, 9, (500, 3))).write.parquet(f"{tmp_path}/cloud")
    cloud = spark.read.parquet(f"{tmp_path}/cloud")
    cells = graph._Cells(cloud, 1.0, ("x", "y"), ())
    edges = [spatial.neighbours(cloud, cloud, 1.0, copy_left=c) for c in (False, True)] + [cells.around(cells.points, graph._offsets(2))]
    for df in edges:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_nearest_of_nothing(spark):
    empty, one = as_cloud(spark, np.empty((0, 3))), as_cloud(spark, np.zeros((1, 3)))
    assert spatial.nearest(empty, one, 2).count() == spatial.nearest(one, empty, 2).count() == 0
    assert spatial.nearest(one, one, 2).count() == 1


def test_instances(spark):
    """Noise: dropped or an instance of its own in space, into the largest instance in the plane."""
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.normal(0, 0.1, (10, 3)), rng.normal(50, 0.1, (12, 3)), [[200, 200, 200], [300, 300, 300]], rng.uniform(0, 900, (3, 3))])
    cat = ["tree"] * 24 + ["ground"] * 3
    df = as_cloud(spark, xyz).withColumn("category", F.element_at(F.array(*map(F.lit, cat)), (F.col("pid") + 1).cast("int")))
    space = {r.pid: r.instance_id for r in classify.instances(df.where("category = 'tree'")).collect()}
    assert {space[i] for i in range(10)} == {1} and {space[i] for i in range(10, 22)} == {2} and 22 not in space
    plane = {r.pid: r.instance_id for r in classify.instances(df, space=False).collect()}
    assert plane[22] == plane[23] == 2 and {plane[i] for i in range(24, 27)} == {1} and len(plane) == 27


def test_tree_layers(spark):
    rng = np.random.default_rng(5)
    trees = [np.column_stack([rng.normal(10 * k, 0.4, 60), rng.normal(0, 0.4, 60), np.linspace(0, 6, 60)]) for k in range(3)]
    few = np.column_stack([np.full(4, 90.0), np.zeros(4), np.linspace(0, 0.5, 4)])
    got = {r.pid: r.tree_id for r in inference.tree_layers(as_cloud(spark, np.concatenate([*trees, few]))).collect()}
    assert all(len({got[i] for i in range(60 * k, 60 * k + 60) if i in got}) == 1 for k in range(3))
    assert sorted(set(got.values())) == [1, 2, 3] and not any(i in got for i in range(180, 184))


def test_building_instances(spark):
    """Two roof halves that touch are one building, another one apart."""
    x, y = (a.ravel() for a in np.meshgrid(np.arange(0, 4, 0.4), np.arange(0, 4, 0.4)))
    first = np.column_stack([x, y, 5 + 0.2 * np.minimum(x, 3.6 - x)])
    xyz = np.concatenate([first, first + [30, 0, 0]])
    got = {r.pid: r.building_id for r in inference.building_instances(as_cloud(spark, xyz), merge=3.0).collect()}
    a, b = {got.get(i) for i in range(100)} - {None}, {got.get(i) for i in range(100, 200)} - {None}
    assert a == {1} and b == {2}


def test_nearest_with_a_far_outlier(spark):
    """One point far away doesn't widen the cells of the others, and coinciding points end the search for a width."""
    rng = np.random.default_rng(4)
    xyz = np.vstack([rng.random((400, 3)), [[1e7, 1e7, 1e7]]])
    got = spatial.nearest(as_cloud(spark, xyz), as_cloud(spark, xyz), 4, ("x", "y", "z"))
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    want = {(i, int(j)) for i in range(401) for j in np.lexsort((np.arange(401), d[i]))[:4]}
    assert {(r.pid, r.other) for r in got.collect()} == want
    assert spatial.good_radius(as_cloud(spark, xyz), 4, ("x", "y", "z")) < 10
    assert spatial.good_radius(as_cloud(spark, [[0, 0, 0]] * 50 + [[1, 1, 1]]), 3, ("x", "y")) > 0


def test_last_known_over_ranges(spark):
    """One group of most rows is spread over ranges, and every row has the last value before it, whatever lies between; null groups are a group."""
    from pointloom.operators.prefix import last_known

    rng = random.Random(1)
    rows = [(g, i, v) for g, n in ((1, 4000), (2, 30), (None, 50)) for i, v in enumerate(float(rng.randint(0, 9)) if rng.random() < (0.002 if g == 1 else 0.3) else None for _ in range(n))]
    df = spark.createDataFrame(rows, "g int, pid int, v double").repartition(6)
    want, last = {}, {}
    for g, i, v in rows:
        last[g] = v if v is not None else last.get(g)
        want[g, i] = last[g]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = last_known(df, ["g"], ["pid"], F.col("v"), "last").collect()
        dealt = df.repartitionByRange("g", "pid").where("g = 1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.g, r.pid): r["last"] for r in got} == want and len(got) == len(rows)
    assert len(dealt) > 4  # of eight tasks


def test_either_side_may_be_copied(spark):
    """The pairs are the same whichever side goes to the cells around."""
    rng = random.Random(2)
    a, b = (spark.createDataFrame([(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(n)], "pid bigint, x double, y double") for n in (40, 300))
    pairs = [sorted((r.pid, r.other, r.d2) for r in spatial.neighbours(a, b, 0.8, ("x", "y"), copy_left=c).collect()) for c in (False, True)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 100


@pytest.mark.parametrize(("dims", "eps"), [(("x", "y"), 0.05), (("x", "y"), 1.0), (("x", "y", "z"), 0.3)])
def test_components_by_cells(spark, dims, eps):
    """Blobs, a chain at just the distance, lone and repeated points, groups and points that aren't finite: components by breadth-first search."""
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.normal(size=(150, 3)) * 0.4, rng.uniform(-3, 3, (120, 3)), np.stack([np.arange(20) * eps, np.full(20, 7.0), np.zeros(20)], 1), np.full((10, 3), -5.0)])
    group = np.where(np.arange(len(xyz)) % 3 == 0, 1, 2)
    rows = [(i, *map(float, p), int(g)) for i, (p, g) in enumerate(zip(xyz, group, strict=True))] + [(900, float("nan"), 0.0, 0.0, 1), (901, None, 0.0, 0.0, 2), (902, float("inf"), 0.0, 0.0, 2)]
    df = spark.createDataFrame(rows, "pid bigint, x double, y double, z double, g int").repartition(4)
    used, comp = xyz[:, : len(dims)], {}
    for s in range(len(xyz)):
        if s not in comp:
            front = [s]
            comp[s] = s
            while front:
                d2 = ((used - used[front.pop()]) ** 2).sum(1)
                for j in np.flatnonzero((d2 <= eps * eps) & (group == group[s])).tolist():
                    if j not in comp:
                        comp[j] = s
                        front.append(j)
    want = comp | {900: 900, 901: 901, 902: 902}
    got = graph.eps_components(df, eps, dims, ("g",)).collect()
    assert {r.pid: r.comp for r in got} == want and len(got) == len(rows)


def test_a_blob_makes_no_pairs(spark):
    """Most points in one spot: the rows written on the way to clusters are a few for each point."""
    rng = np.random.default_rng(5)
    n = 3000
    xyz = np.concatenate([rng.normal(size=(n, 2)) * 0.05, rng.uniform(-40, 40, (500, 2))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid bigint, x double, y double").repartition(4)
    sizes = []
    whole = graph.stored

    def counted(frame, name):
        out = whole(frame, name)
        sizes.append(out.count())
        return out

    graph.stored = counted
    try:
        got = {r.pid: r.cluster for r in graph.dbscan(df, 0.5, 5).collect()}
    finally:
        graph.stored = whole
    assert max(sizes) <= 10 * len(xyz)
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(2) <= 0.25
    core = near.sum(1) >= 5
    assert all((got[i] == 0) == (near[i] & core)[:n].any() for i in range(n)) and all(got[i] == -1 for i in range(n, len(xyz)) if not (near[i] & core).any())


def test_rows_meet_cells_in_blocks(spark):
    """A point is copied to the blocks that eps reaches, fewer than two on average, not to each cell; it meets exactly the cells whose square comes within eps."""
    rng = np.random.default_rng(12)
    xy = rng.uniform(-40, 40, (2000, 2))
    cloud = spark.createDataFrame([(i, float(x), float(y), i % 2) for i, (x, y) in enumerate(xy)], "pid bigint, x double, y double, g int")
    cells = graph._Cells(cloud, 1.0, ("x", "y"), ("g",))
    offsets = graph._offsets(2)
    assert cells.to_blocks(cells.points, offsets, F.col, F.col).count() < 2 * len(xy)
    got = sorted((r.pid, r.b_rep) for r in cells.around(cells.points, offsets).collect())
    width = (1 - 1e-9) / 2**0.5
    at = np.floor(xy / width)
    first = {}
    for i, c in enumerate(at):
        first.setdefault((*c, i % 2), i)
    want = []
    for (*c, g), rep in first.items():
        low = np.array(c) * width
        gap = np.maximum(np.maximum(low - xy, xy - low - width), 0)
        want += [(i, rep) for i in np.flatnonzero(((gap**2).sum(1) <= 1) & (np.arange(len(xy)) % 2 == g)).tolist()]
    assert got == sorted(want)
