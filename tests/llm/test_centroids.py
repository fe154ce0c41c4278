import hashlib
import math

import numpy as np
import pytest

from pointloom.llm import centroids
from pointloom.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, v int, id string"


def brute(rows):
    """The rules, vector by vector."""
    kept = [(r.vec_id, [min(max(math.floor(1024 * float(x)), -centroids.BOUND), centroids.BOUND) for x in r.embedding]) for r in rows if r.embedding is not None and len(r.embedding) == 64 and all(x is not None and math.isfinite(x) for x in r.embedding)]
    name = lambda i: hashlib.sha256(f"3:{'null' if i is None else i}".encode()).hexdigest()
    seeds = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:8]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(seeds)), key=lambda k: (far(v, seeds[k]), k))
    for _ in range(10):
        to = [nearest(v) for _, v in kept]
        for k in range(len(seeds)):
            own = [v for (_, v), t in zip(kept, to, strict=True) if t == k]
            if own:
                seeds[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    to = [nearest(v) for _, v in kept]
    d = [far(v, seeds[t]) for (_, v), t in zip(kept, to, strict=True)]
    of = {k: sum(x for x, t in zip(d, to, strict=True) if t == k) for k in set(to)}
    return sorted((str(i), t, x, of[t], sum(d), hashlib.sha256(",".join(map(str, seeds[t])).encode()).hexdigest()) for (i, _), t, x in zip(kept, to, d, strict=True))


def rows_of(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_query_against_brute_force(spark):
    want = brute(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect())
    assert rows_of(QUERIES["op13_centroids"](spark, "/root/testdata/sf0.001")) == want


def messy(n_hot):
    rng = np.random.default_rng(3)
    row = lambda i, v: (i, None if v is None else [None if x is None else float(x) for x in v], 1, "c", 2, "x")
    plain = [row(i, rng.normal(size=64) * 0.3) for i in range(40)]
    hot = [row(100 + i, np.full(64, 0.25)) for i in range(n_hot)]
    odd = [row(1000, None), row(1001, [0.1] * 63), row(1002, [0.1] * 65), row(1003, [None] + [0.1] * 63), row(1004, [float("nan")] + [0.1] * 63), row(1005, [float("inf")] + [0.1] * 63), row(1006, []), row(None, [0.1] * 64), row(None, [0.1] * 64), row(3, rng.normal(size=64)), plain[3], plain[3], row(1007, [-0.0001] * 64)]
    return [*plain, *hot, *odd]


@pytest.mark.parametrize("extreme", [False, True])
def test_messy_rows(spark, extreme):
    """Nulls, wrong lengths, no numbers, repeated rows and ids, a vector of a third of the rows, values beyond the bound."""
    rows = messy(30) + ([(2000, [3e38] * 64, None, None, None, None), (2001, [-3e38, 3e38] * 32, None, None, None, None)] if extreme else [])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(centroids.report(df)) == brute(df.collect())


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    df = spark.createDataFrame(messy(0)[:n] + [(9, None, None, None, None, None)], SCHEMA)
    assert rows_of(centroids.report(df)) == brute(df.collect())
    assert centroids.report(df.where("false")).count() == 0


@pytest.mark.parametrize("spread", [0.02, 0.2, 3.0])
def test_balls_go_whole_and_right(spread):
    """Filtering gives the sums of vector by vector assignment; with tight clusters most vectors are never looked at alone."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-500, 500, (8, 64))
    v = np.concatenate([m + np.rint(rng.normal(size=(400, 64)) * 100 * spread).astype(np.int64) for m in middles])
    tree, order = centroids.BallTree.of(v)
    assert (tree.vectors == v[order]).all() and sorted(order) == list(range(len(v)))
    best = ((v[:, None] - middles) ** 2).sum(2).argmin(1)
    n, sums = tree.totals(middles)
    assert (n == np.bincount(best, minlength=8)).all() and all((sums[k] == v[best == k].sum(0)).all() for k in range(8))
    to, d = tree.assigned(middles)
    assert (to == best[order]).all() and (d == ((v - middles[best]) ** 2).sum(1)[order]).all()
    if spread == 0.02:
        assert len(tree.filtered(middles)[2]) < len(v) / 2
