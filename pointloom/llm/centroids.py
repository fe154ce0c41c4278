"""Centroid clustering of integer vectors by ball-tree filtering.

1. Each task cuts the vectors that it reads into runs of TREE_ROWS and builds a
   metric tree of each run. A node (a ball) has its number of vectors, their
   integer sum and a radius around the floor of their mean. Trees are written
   once, to the shared folder, and serve all rounds.
2. A round sends the k centroids to the tasks. From the root down, a ball goes as
   a whole to its nearest centroid z if no vector of it can be nearer to another:
   d(z) + radius < d(other) - radius. Its count and sum are then the count and sum
   of its vectors. Other balls are opened; what is left of the leaves is assigned
   vector by vector, by exact integer distances, ties to the smaller number.
3. A task adds up one row per centroid, Spark adds up the tasks' rows, and the
   driver divides at most k sums. Rounds end early once no centroid moves.

No vector is shuffled and there is no group by cluster, so a cluster or a vector
that holds any share of the rows costs no task more than others: equal vectors
make a ball of radius 0, which is never opened.

Defined results: only vectors of DIMS components, none null, NaN or infinite, take
part; a component x is floor(SCALE * x), held within +-BOUND (which real embeddings
don't meet) so that distances fit a long; repeated rows and null ids each give a
row, a null id hashing as `3:null`; of equal hashes the lesser vector comes first;
with fewer vectors than centroids there are as many centroids as vectors; a sum of
distances beyond a long is null; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.scratch import stored

DIMS = 64
SCALE = 1024
BOUND = 1 << 27
CENTROIDS = 8
ROUNDS = 10
TREE_ROWS = 4096
LEAF_ROWS = 32

TREE = "ids array<{id}>, vectors binary, start array<int>, stop array<int>, child array<int>, radius array<double>, sums binary"


def quantised(vectors: DataFrame, embedding: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, v array<bigint>) of the vectors that take part."""
    x = F.col(embedding)
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    bounded = F.transform(x, lambda e: F.floor(F.least(F.greatest(e.cast("double") * SCALE, F.lit(-float(BOUND))), F.lit(float(BOUND)))).cast("long"))
    return vectors.where((F.size(x) == DIMS) & good).select(F.col(id_col).alias("id"), bounded.alias("v"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The vectors of the k smallest hashes of their ids."""
    named = F.concat(F.lit("3:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    seeds = rows.select(F.sha2(named, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in seeds], np.int64).reshape(-1, DIMS)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per vector and a column per centroid."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if v.shape[1] * (2 * most) ** 2 < 1 << 53:  # doubles are exact and multiply faster
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)


class BallTree:
    """Vectors in the order of the leaves; node 0 is the root, and the children of node i are child[i] and child[i] + 1, or none if child[i] is 0."""

    def __init__(self, vectors: np.ndarray, start, stop, child, radius, sums):
        self.vectors, self.start, self.stop, self.child, self.radius, self.sums = vectors, start, stop, child, radius, sums
        self.count = stop - start
        self.centre = sums // np.maximum(self.count, 1)[:, None]

    @classmethod
    def of(cls, vectors: np.ndarray) -> tuple[BallTree, np.ndarray]:
        """The tree, and the order in which it holds the vectors."""
        order, start, stop, child, radius, sums = np.arange(len(vectors)), [0], [len(vectors)], [0], [], []
        at = 0
        while at < len(start):
            own = order[start[at] : stop[at]]
            v = vectors[own]
            sums.append(v.sum(0))
            # a little more than the root, so that rounding never makes a ball too small
            radius.append(float(np.sqrt(((v - sums[-1] // len(v)) ** 2).sum(1).max())) * (1 + 1e-9))
            if len(v) > LEAF_ROWS and radius[-1] > 0:
                widest = int((v.max(0) - v.min(0)).argmax())
                half = len(v) // 2
                order[start[at] : stop[at]] = own[np.argpartition(v[:, widest], half)]
                child[at] = len(start)
                start += [start[at], start[at] + half]
                stop += [start[at] + half, stop[at]]
                child += [0, 0]
            at += 1
        return cls(vectors[order], *(np.array(x, np.int64) for x in (start, stop, child)), np.array(radius), np.array(sums)), order

    def filtered(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(balls, their centroids, vectors, their centroids): what goes as whole balls, and the rest."""
        balls, to, leaves, front = [], [], [], np.zeros(1, np.int64)
        while len(front):
            d = np.sqrt(squared(self.centre[front], centroids).astype(np.float64))
            best, r = d.argmin(1), self.radius[front]
            nearest = d[np.arange(len(d)), best]
            d[np.arange(len(d)), best] = np.inf
            whole = (r == 0) | ((nearest + 2 * r) * (1 + 1e-9) + 1e-6 < d.min(1))
            # the vectors of a ball without radius are its centre: their nearest centroid is found exactly
            points = whole & (r == 0)
            best[points] = squared(self.centre[front[points]], centroids).argmin(1)
            balls.append(front[whole])
            to.append(best[whole])
            rest = front[~whole]
            leaves.append(rest[self.child[rest] == 0])
            inner = self.child[rest[self.child[rest] > 0]]
            front = np.concatenate([inner, inner + 1])
        opened = np.concatenate(leaves)
        rows = np.concatenate([np.empty(0, np.int64), *(np.arange(a, b) for a, b in zip(self.start[opened], self.stop[opened], strict=True))])
        return np.concatenate(balls), np.concatenate(to), rows, squared(self.vectors[rows], centroids).argmin(1)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, sum) of the vectors nearest to each centroid."""
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        balls, to, rows, to_row = self.filtered(centroids)
        for k in range(len(centroids)):
            whole, single = balls[to == k], rows[to_row == k]
            n[k] = self.count[whole].sum() + len(single)
            sums[k] = self.sums[whole].sum(0) + self.vectors[single].sum(0)
        return n, sums

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each vector."""
        out = np.empty(len(self.vectors), np.int64)
        balls, to, rows, to_row = self.filtered(centroids)
        for ball, k in zip(balls, to, strict=True):
            out[self.start[ball] : self.stop[ball]] = k
        out[rows] = to_row
        return out, ((self.vectors - centroids[out]) ** 2).sum(1)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMS)


def trees(rows: DataFrame) -> DataFrame:
    """A row for each tree, built by the task that reads its vectors."""

    def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        return pa.array([x.tolist() for x in values], pa.list_(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(first, TREE_ROWS)
                tree, order = BallTree.of(_matrix(part.column("v")))
                ids = part.column("id").take(pa.array(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([tree.vectors.astype("<i4").tobytes()]), *(lists([x], pa.int32()) for x in (tree.start, tree.stop, tree.child)), lists([tree.radius], pa.float64()), pa.array([tree.sums.astype("<i8").tobytes()])],
                    ["ids", "vectors", "start", "stop", "child", "radius", "sums"],
                )

    return rows.mapInArrow(run, TREE.format(id=rows.schema["id"].dataType.simpleString()))


def _read(batch: pa.RecordBatch) -> Iterator[BallTree]:
    for k in range(batch.num_rows):
        at = lambda c: batch.column(c)[k]  # noqa: B023, E731
        start, stop, child = (np.array(at(c).values, np.int64) for c in ("start", "stop", "child"))
        yield BallTree(np.frombuffer(at("vectors").as_buffer(), "<i4").astype(np.int64).reshape(-1, DIMS), start, stop, child, np.array(at("radius").values), np.frombuffer(at("sums").as_buffer(), "<i8").reshape(-1, DIMS))


def next_centroids(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; those without vectors stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64)
        for batch in batches:
            for tree in _read(batch):
                more = tree.totals(centroids)
                n, sums = n + more[0], sums + more[1]
        # a row for each component of a sum, and one for the count
        has, full = np.flatnonzero(n), np.column_stack([sums, n])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(has, DIMS + 1), pa.int32()), pa.array(np.tile(np.arange(DIMS + 1), len(has)), pa.int32()), pa.array(full[has].ravel())], ["cluster", "part", "total"])

    parts = forest.drop("ids").mapInArrow(run, "cluster int, part int, total bigint")
    full = np.zeros((k, DIMS + 1), object)
    for r in parts.groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect():  # k * (DIMS + 1) rows at most
        full[r.cluster, r.part] = r.total
    moved = centroids.copy()
    for j in np.flatnonzero(full[:, DIMS]):
        moved[j] = full[j, :DIMS] // full[j, DIMS]
    return moved


def clustered(vectors: DataFrame, embedding: str = "embedding", id_col: str = "vec_id", k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) for each vector that takes part, and the final centroids."""
    rows = quantised(vectors, embedding, id_col)
    kind = rows.schema["id"].dataType.simpleString()
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    forest = stored(trees(rows), "ball_trees")
    for _ in range(rounds):
        moved = next_centroids(forest, centroids)
        if (moved == centroids).all():
            break
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, tree in enumerate(_read(batch)):
                to, d = tree.assigned(centroids)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[row].values, pa.array(to, pa.int32()), pa.array(d)], ["id", "cluster", "distance"])

    return forest.mapInArrow(run, f"id {kind}, cluster int, distance bigint"), centroids


def report(vectors: DataFrame, embedding: str = "embedding", id_col: str = "vec_id", k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that takes part."""
    found, centroids = clustered(vectors, embedding, id_col, k, rounds)
    found = stored(found, "assigned")
    spark = vectors.sparkSession
    named = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    hashes = spark.createDataFrame(named, "cluster int, centroid_sha256 string")
    total = lambda x: F.sum(F.col(x).cast("decimal(38,0)"))
    per = found.groupBy("cluster").agg(total("distance").alias("part")).join(hashes, "cluster")
    per = per.crossJoin(F.broadcast(per.agg(total("part").alias("all"))))  # one row on the right
    per = per.select("cluster", F.expr("try_cast(part AS bigint)").alias("cluster_inertia"), F.expr("try_cast(`all` AS bigint)").alias("inertia"), "centroid_sha256")
    # at most k rows
    return found.join(F.broadcast(per), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
