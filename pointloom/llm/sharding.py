"""Sharding by best-fit decreasing: indivisible groups into the fewest fixed-capacity shards, or into a given number of near-equal ones.

Groups are the documents of one text. Groups of one size are interchangeable, so
the packing is worked out on the histogram of group sizes: only (size, number of
groups) reaches the driver, at most sqrt(2 * bytes) rows however the sizes fall,
and far fewer where sizes repeat. Sizes in decreasing order enter the bin with the
least room that still fits them, found in a balanced tree of remaining
capacities; a bin takes as many of a size as it has room for before the next one
is asked, which is what packing them one by one does too. The plan says which
ranks of which size go where; Spark ranks the groups within their size by digest
and joins them with it.

Defined results: a null text has the size of an empty one; null ids come first in
a shard; repeated rows each take a slot; groups of one size tie by their digest; a
group larger than the capacity takes a bin of its own; a very long text is one
row of its size; an empty table gives an empty result; columns other than id and
text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.text import sha256_hex, whole
from pointloom.operators.prefix import running_sum
from pointloom.scratch import stored

SHARDS = 24
FINE = 1 << 14  # the capacity of near-equal shards is searched to this part of it
OVERHEAD = 8  # bytes that a row has besides its text
BUCKETS = 4096  # parts of a shard whose slots are numbered apart
SIZE_BUCKETS = 256  # parts of a size whose groups are numbered apart
CELL = 256  # ranks that the plan is looked up by


class Capacities:
    """A balanced tree (treap) of (room, bin), for the least room that is enough."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _weight(key: tuple[int, int]) -> int:
        return (key[1] * 0x9E3779B97F4A7C15 + key[0] * 0xC2B2AE3D27D4EB4F) % (1 << 64)

    def _split(self, node, key):
        """Trees of the keys under and from key on; a node is [key, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[2], key)
            node[2] = low
            return node, high
        low, high = self._split(node[1], key)
        node[1] = high
        return low, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if self._weight(low[0]) > self._weight(high[0]):
            low[2] = self._merge(low[2], high)
            return low
        high[1] = self._merge(low, high[1])
        return high

    def add(self, room: int, bin_no: int) -> None:
        low, high = self._split(self.root, (room, bin_no))
        self.root = self._merge(self._merge(low, [(room, bin_no), None, None]), high)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns the least (room, bin) with room of at least need."""
        low, high = self._split(self.root, (need, -1))
        if high is None:
            self.root = low
            return None
        at = high
        while at[1] is not None:
            at = at[1]
        _, rest = self._split(high, (at[0][0], at[0][1] + 1))
        self.root = self._merge(low, rest)
        return at[0]


Run = tuple[int, int, int, int, int]  # size, first rank, number of ranks, first bin, ranks per bin


def best_fit(sizes: Iterable[tuple[int, int]], capacity: int, bins: int | None = None) -> list[Run] | None:
    """Where the groups of each size go, for (size, number) in decreasing size; None if more than `bins` are needed. Without a limit, oversized groups have bins of their own."""
    rooms, runs, used = Capacities(), [], 0
    for size, n in sizes:
        rank = 0
        while rank < n and (found := rooms.take(size)) is not None:
            fit = min(n - rank, found[0] // size)
            runs.append((size, rank, fit, found[1], fit))
            rooms.add(found[0] - fit * size, found[1])
            rank += fit
        if rank < n:  # the rest fills new bins one after another
            each = max(1, capacity // size)
            new = -(-(n - rank) // each)
            if bins is not None and (size > capacity or used + new > bins):
                return None
            runs.append((size, rank, n - rank, used, each))
            for k in range(new):
                rooms.add(max(0, capacity - size * min(each, n - rank - k * each)), used + k)
            used += new
    return runs


def equal_bins(sizes: Sequence[tuple[int, int]], bins: int) -> list[Run]:
    """Best-fit decreasing into `bins` bins at the least capacity that works, to 1/FINE of it."""
    if not sizes:
        return []
    low = max(sizes[0][0], -(-sum(size * n for size, n in sizes) // bins))
    step = max(1, low // FINE)
    if (plan := best_fit(sizes, low, bins)) is not None:
        return plan
    high = low + step
    while (plan := best_fit(sizes, high, bins)) is None:
        low, high = high, high + 2 * (high - low)
    while high - low > step:  # low is too small, high is enough
        middle = (low + high) // 2
        if (better := best_fit(sizes, middle, bins)) is not None:
            plan, high = better, middle
        else:
            low = middle
    return plan


def sized(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, group, size, text_crc32) without texts, written once."""
    t = whole(text)
    return stored(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(sha256_hex(t)).alias("group"), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32")), "sizes")


def ranked(groups: DataFrame) -> DataFrame:
    """Adds `rank` to (group, group_size): 0, 1, ... among the groups of one size."""
    rows = groups.withColumn("one", F.lit(1).cast("long")).withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(SIZE_BUCKETS)))
    return running_sum(rows, ["group_size"], "bucket", ["group"], "one", "rank").drop("one", "bucket")


def sharded(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, shard, slot): into `shards` near-equal shards, or as few as best fit needs at `capacity` bytes. Slots of a shard go from 0 in (bucket, id) order."""
    spark, rows = docs.sparkSession, sized(docs, text, id_col)
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("group_size")), "groups")
    sizes = sorted(((r["group_size"], r["count"]) for r in groups.groupBy("group_size").count().collect()), reverse=True)
    plan = spark.createDataFrame(best_fit(sizes, capacity) if capacity else equal_bins(sizes, shards or 1), "group_size bigint, first bigint, n bigint, bin bigint, each bigint")
    plan = plan.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor((F.col("first") + F.col("n") - 1) / CELL))))
    at = ranked(groups).withColumn("cell", F.floor(F.col("rank") / CELL)).join(plan, ["group_size", "cell"]).where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    at = stored(at.select("group", (F.col("bin") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).cast("int").alias("shard")), "shards")
    dealt = rows.join(at, "group").withColumn("bucket", F.pmod(F.xxhash64("id", "group"), F.lit(BUCKETS)))
    dealt = running_sum(dealt.withColumn("one", F.lit(1).cast("long")), ["shard"], "bucket", ["id", "text_crc32"], "one", "slot")
    return dealt.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
