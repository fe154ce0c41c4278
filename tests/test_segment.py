"""Trees and buildings against sequential versions on small scenes."""

import numpy as np
import pytest

from pointloom.operators import features, segment, spatial
from tests.test_graph import as_cloud


def comps(points, eps):
    left, out = set(range(len(points))), []
    while left:
        seed = min(left)
        group, queue = {seed}, [seed]
        left.discard(seed)
        while queue:
            u = queue.pop()
            for v in [v for v in left if ((points[u] - points[v]) ** 2).sum() <= eps * eps]:
                left.discard(v)
                group.add(v)
                queue.append(v)
        out.append(sorted(group))
    return [c for c in out if len(c) >= 2]


def brute_trees(p, s, spacing, crown, least):
    xy, z = p[:, :2], p[:, 2]
    high = np.flatnonzero((z >= max(0.3, 3 * s)) & (z <= 15))
    picked = []
    for c in comps(xy[high], max(3 * s, 0.15)):
        g = high[c]
        low, top = z[g].min(), z[g].max()
        if len(g) >= 8 and top - low > 1:
            part = [i for i in g if z[i] <= low + 0.6 * (top - low)]
            picked += part if len(part) >= 3 else []
    picked = np.array(sorted(picked))
    trunks = [picked[c] for c in comps(xy[picked], max(spacing, 3 * s))]
    centre = [xy[t].mean(0) for t in trunks]
    groups = list(range(len(trunks)))
    for i in range(len(trunks)):
        for j in range(i):
            if np.linalg.norm(centre[i] - centre[j]) < spacing:
                a, b = groups[i], groups[j]
                groups = [min(a, b) if g in (a, b) else g for g in groups]
    merged = {}
    for g, t in zip(groups, trunks, strict=True):
        merged[g] = sorted([*merged.get(g, []), *t])
    trunks = sorted((t for t in merged.values() if len(t) >= max(5, int(10 * s))), key=min)
    label, k = np.zeros(len(p), int), 0
    for t in trunks:
        t = np.array(t)
        top, mid = z[t].max(), xy[t].mean(0)
        ext = max(np.ptp(p[t, 0]), np.ptp(p[t, 1]))
        r = min(max(3 * ext, 6 * s, 0.8 * spacing), 2 * crown)
        d = np.linalg.norm(xy - mid, axis=1)
        hit = np.flatnonzero((d < r) & (z > top - 0.1) & (z <= top + 1.5 * r + 0.5) & (label == 0))
        if len(hit) < 5:
            hit = np.flatnonzero((d < 1.5 * r) & (z > top - 0.2) & (z <= top + 1.5 * r + 1.0) & (label == 0))
        if len(hit) > 5 and (parts := comps(xy[hit], 3 * s)):
            hit = hit[max(parts, key=lambda c: (len(c), -min(hit[c])))]
        tree = sorted({*t, *hit})
        if np.ptp(z[tree]) >= 0.5 * least:
            k += 1
            label[tree] = k
    return label


@pytest.mark.parametrize("gap", [6.0, 1.2])
def test_trees(spark, gap):
    rng = np.random.default_rng(int(gap))
    parts = []
    for k in range(5):
        z = np.linspace(0.4, 4, 30)
        trunk = np.column_stack([gap * k + rng.normal(0, 0.03, 30), rng.normal(0, 0.03, 30), z])
        crown = np.column_stack([gap * k + rng.normal(0, 0.5, 40), rng.normal(0, 0.5, 40), rng.uniform(2.2, 5, 40)])
        parts += [trunk, crown]
    p = np.concatenate([*parts, np.column_stack([rng.uniform(-2, 30, 20), rng.uniform(-5, 5, 20), np.zeros(20)])])
    labels, metrics = segment.segment_trees(as_cloud(spark, p), point_spacing=0.1, min_tree_spacing=0.5, max_crown_width=1.0)
    got = {r.pid: r.tree_id for r in labels.collect()}
    want = brute_trees(p, 0.1, 0.5, 1.0, 1.0)
    assert [got[i] for i in range(len(p))] == want.tolist() and want.max() >= 1
    assert {r.tree_id for r in metrics.collect()} == set(range(1, want.max() + 1))


def test_buildings(spark):
    rng = np.random.default_rng(7)
    roofs = [np.column_stack([rng.uniform(a, a + 4, 120), rng.uniform(0, 4, 120), 3 + rng.uniform(0, 1.5, 120)]) for a in (0, 5.3, 30)]
    walls = np.column_stack([rng.uniform(-0.5, 0, 15), rng.uniform(0, 4, 15), rng.uniform(2.6, 2.9, 15)])
    p = np.concatenate([*roofs, walls, np.column_stack([rng.uniform(-3, 40, 60), rng.uniform(-3, 8, 60), rng.uniform(0, 0.5, 60)])])
    labels, metrics = segment.segment_buildings(as_cloud(spark, p), point_spacing=0.3, building_eps=1.0)
    got = {r.pid: r.building_id for r in labels.collect()}
    for k in range(3):
        most = [got[i] for i in range(120 * k, 120 * k + 120)]
        assert max(most.count(v) for v in set(most) - {0}) >= 110
    rows = {r.building_id: r for r in metrics.collect()}
    assert sorted(rows) == [1, 2, 3] and all(3 < r.width < 5 and 8 < r.area < 20 for r in rows.values())
    assert segment.corners(metrics).count() == 24
    sizes = {k: sum(v == k for v in got.values()) for k in rows}
    assert sizes == {k: r.point_count for k, r in rows.items()}


@pytest.mark.parametrize(("block", "angle"), [(spatial.BLOCK, 0.6), (7, 0.7)])
def test_region(spark, monkeypatch, block, angle):
    """Against all pairs, with cells in one block and in many, points that coincide and one that is far off; no pair of points is a row of a table."""
    monkeypatch.setattr(spatial, "BLOCK", block)
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.uniform(-1, 2, (500, 3)), np.full((300, 3), 0.4), [[30.0, 30.0, 30.0]]])
    step = p[None] - p[:, None]
    near = (step**2).sum(2) <= 0.5**2
    n = (step * near[:, :, None]).sum(1)
    length = np.linalg.norm(n, axis=1)
    n = np.where(length[:, None] > 1e-12, n / np.maximum(length, 1e-300)[:, None], [0.0, 1.0, 0.0])
    cloud = as_cloud(spark, p)
    got = {r.pid: (r.nx, r.ny, r.nz) for r in features.mean_offsets(cloud, 0.5).collect()}
    assert sorted(got) == list(range(len(p))) and np.allclose([got[k] for k in range(len(p))], n, atol=1e-9)
    joined = near & (np.abs(n @ n.T) > angle)
    seed = int(((p - 0.5) ** 2).sum(1).argmin())
    want, queue = {seed}, [seed]
    while queue:
        for v in np.flatnonzero(joined[queue.pop()]).tolist():
            if v not in want:
                want.add(v)
                queue.append(v)
    rows = segment.region(cloud, (0.5, 0.5, 0.5), 0.5, angle).collect()
    assert sorted(r.pid for r in rows) == sorted(want) and 300 < len(want) < 790
    assert [r.pid for r in segment.region(cloud, (30, 30, 30), 0.5, angle).collect()] == [len(p) - 1]


def test_unknown_parameter(spark):
    with pytest.raises(ValueError, match="unknown"):
        segment.given(segment.TREES, {"no_such": 1})


def test_nearest_ranks_where_it_joins(spark, monkeypatch):
    """Of a cloud and itself, the first round shuffles points by cell, not what they meet by pid; far points go on to later rounds."""
    rng = np.random.default_rng(12)
    at = np.concatenate([rng.uniform(0, 10, (300, 3)), [[400.0, 0, 0], [0, 900, 0]]])
    cloud = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "pid bigint, x double, y double, z double")
    plans, real = [], spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df, name: (name == "nearest" and plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, name))[1])
    got = {}
    for r in spatial.nearest(cloud, cloud, 4).collect():
        got.setdefault(r.pid, {})[r["rank"]] = r.other
    assert "hashpartitioning(pid" not in plans[0] and len(plans) > 1
    d2 = ((at[:, None, :2] - at[None, :, :2]) ** 2).sum(2)
    assert got == {k: {n + 1: int(o) for n, o in enumerate(np.lexsort([np.arange(len(at)), d2[k]])[:4])} for k in range(len(at))}
