"""Near-duplicate join on five-word shingles: a MinHash LSH forest, then exact verification.

1. Texts of equal words fold into one node. Every node has TREES labels of DEPTH
   MinHash values, the paths of a prefix trie per tree, and a byte sketch of all.
2. Trie nodes of the longest prefixes are searched first: nodes that share one and
   whose sketches leave similarity possible are linked. What is found measures the
   recall of that length: a pair of similarity s shares a prefix of length k in some
   tree with probability 1 - (1 - s^k)^TREES, so the links of a node stand for the
   sum of the inverses of theirs. Nodes that so have found RECALL of their partners
   are settled; for all others, those without a link among them, the matched prefix
   is shortened by one and their trie nodes are searched again, against settled
   members too, down to the length that has RECALL even right at the threshold
   (prefix_length). A large trie node is dealt out as pairs of blocks.
3. Components of those links are verified exactly, all pairs of a component by
   its shingle sets, again in pairs of blocks. Counts of links and a spanning
   forest come out, never all pairs; components of the forest are the classes.

Result: one row per input row: id, class_id (least id of the class), n_links
(other documents of Jaccard similarity of at least THRESHOLD, copies counted) and
n_text_links (the same, counting different texts once).

Defined results: words are runs of non-space characters, compared as they are; a
text of one to four words has one shingle, all its words; a null text or one
without words has no shingles, stands alone and has no links; a text of any
length is compared by all its shingles; texts are told apart by their words alone,
so rows that share an id, or have none, take part with their own text; a null id is
above all others, and the class of texts without any id is null; repeated rows count
as copies; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.text import trimmed, whole, words_of_trimmed
from pointloom.operators.graph import connected_components
from pointloom.scratch import fresh, stored

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.999
BLOCK_ROWS = 1024  # of a trie node
BLOCK_SHINGLES = 1 << 19  # of a component
BLOCK_TEXTS = 512  # of a component
MARGIN = 6.0  # standard deviations that a sketch may lie under the threshold


def found_at(length: int, similarity, trees: int = TREES):
    """Probability that a pair shares a prefix of the length in some tree."""
    return 1 - (1 - similarity**length) ** trees


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is found with the target recall: no node needs a shorter one."""
    length = depth
    while length > 1 and found_at(length, threshold, trees) < recall:
        length -= 1
    return length


def shingles(words: Column) -> Column:
    """The set of hashed windows of SHINGLE words; one window if there are fewer words, none if there is no word."""
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, SHINGLE)])), 1, F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0)))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < SHINGLE, F.array(F.xxhash64(F.array_join(words, " "), F.lit(-1)))).otherwise(F.array_distinct(windows))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    n = TREES * DEPTH
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minhash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(rows, TREES * DEPTH) least hashes of non-empty runs of 64-bit values that begin at starts."""
    mixed = values.view(np.uint64)
    x = (mixed ^ (mixed >> np.uint64(29))).astype(np.uint32)
    a, b = _multipliers()
    out = np.empty((len(starts), len(a)), np.uint32)
    ends = np.append(starts[1:], len(x))
    first = 0
    while first < len(starts):  # runs of about 64K values stay in cache
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + 65536, side="right")))
        part = x[starts[first] : ends[last - 1]]
        at, h = starts[first:last] - starts[first], np.empty_like(part)
        for k in range(len(a)):
            np.multiply(part, a[k], out=h)
            h += b[k]
            out[first:last, k] = np.minimum.reduceat(h, at)
        first = last
    return out


def signatures(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, digest of the words, n_shingles, labels array<int>); texts without words have empty labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes, starts = np.diff(offsets), offsets[:-1] - offsets[0]
            full = sizes > 0
            labels = minhash(values, starts[full]) if full.any() else np.empty((0, TREES * DEPTH), np.uint32)
            at = np.concatenate([[0], np.cumsum(full * TREES * DEPTH)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(labels.view(np.int32).ravel()))], ["id", "digest", "n_shingles", "labels"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), words_of_trimmed(trimmed(whole(text))).alias("words"))
    rows = rows.select("id", _digest(F.col("words")).alias("digest"), shingles(F.col("words")).alias("shingles"))
    return rows.mapInArrow(run, "id bigint, digest string, n_shingles bigint, labels array<int>")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by keys; a group that goes on in the next batch is held back."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        if not held.num_rows:
            continue
        last = np.ones(held.num_rows, bool)
        for k in keys:
            column = held.column(k).to_numpy()
            last &= column == column[-1]
        cut = held.num_rows - int(last[::-1].argmin() if not last.all() else held.num_rows)
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _borders(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        column = table.column(k).to_numpy()
        change |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


class _Sets:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _possible_links(length: int):
    """Per trie node of prefixes of the length, or pair of its blocks: a spanning forest (id, other, null, null) of the pairs whose sketches leave the threshold possible, and for each node (id, null, links, what they stand for)."""
    n = TREES * DEPTH
    least = int(np.floor(n * (THRESHOLD - MARGIN * np.sqrt(THRESHOLD * (1 - THRESHOLD) / n))))
    stands_for = 1 / found_at(length, np.maximum(np.arange(n + 1) / n, THRESHOLD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["key", "bi", "bj"]):
            at = _borders(table, ["key", "bi", "bj"])
            ids, open_ = table.column("id").to_numpy(), table.column("open").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, n)
            sizes, a, b = np.diff(at), [], []
            links, weight = np.zeros(len(ids), np.int64), np.zeros(len(ids))
            for size in range(2, 9):  # small groups: all their pairs at once
                first = at[:-1][sizes == size]
                x, y = np.triu_indices(size, 1)
                for part in np.array_split(first, max(1, len(first) // 20_000)):
                    i, j = (part[:, None] + x).ravel(), (part[:, None] + y).ravel()
                    common = (sketch[i] == sketch[j]).sum(1)
                    ok = common >= least
                    a.append(ids[i[ok]])
                    b.append(ids[j[ok]])
                    for k in (i[ok], j[ok]):
                        np.add.at(links, k, 1)
                        np.add.at(weight, k, stands_for[common[ok]])
            for k in np.flatnonzero(sizes > 8):
                # pairs of settled nodes aren't looked for, so those that aren't settled come first
                order = at[k] + np.argsort(~open_[at[k] : at[k + 1]], kind="stable")
                rows, sets, edges = sketch[order], _Sets(len(order)), []
                for i in range(min(len(rows) - 1, int(open_[order].sum()))):
                    common = (rows[i + 1 :] == rows[i]).sum(1)
                    near = np.flatnonzero(common >= least)
                    inverse = stands_for[common[near]]
                    links[order[i]] += len(near)
                    weight[order[i]] += inverse.sum()
                    links[order[near + i + 1]] += 1
                    weight[order[near + i + 1]] += inverse
                    edges += [(i, j) for j in (near + i + 1).tolist() if sets.join(i, j)]
                if edges:
                    pairs = ids[order[np.array(edges)]]
                    a.append(pairs[:, 0])
                    b.append(pairs[:, 1])
            has = np.flatnonzero(links)
            edges = np.concatenate(b).astype(np.int64)
            none = pa.nulls(len(edges), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*a, ids[has]]), pa.int64()), pa.concat_arrays([pa.array(edges), pa.nulls(len(has), pa.int64())]), pa.concat_arrays([none, pa.array(links[has])]), pa.concat_arrays([none.cast(pa.float64()), pa.array(weight[has])])], ["id", "other", "links", "weight"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of blocks of a component: (id, null, links, linked documents) and forest edges (id, other, 0, 0), by exact set similarity."""
    keys = ["comp", "bi", "bj"]
    for table in _runs(batches, keys):
        at = _borders(table, keys)
        out: list[list] = [[], [], [], []]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            part = table.slice(lo, hi - lo)
            ids = part.column("id").to_numpy()
            if (repeated := ids[1:] == ids[:-1]).any():  # rows come by id
                part = part.filter(pa.array(np.append(True, ~repeated)))
            ids, copies, block = (part.column(c).to_numpy() for c in ("id", "copies", "block"))
            within = part.column("bi")[0].as_py() == part.column("bj")[0].as_py()
            lists = part.column("shingles").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            starts = np.asarray(lists.offsets, dtype=np.int64)
            starts = starts - starts[0]
            # dense numbers for the shingles of this group
            number = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1].ravel()
            sizes, mark = np.diff(starts), np.zeros(int(number.max()) + 1, np.int32)
            n, sets = len(ids), _Sets(len(ids))
            links, docs = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(n):
                mine = number[starts[i] : starts[i + 1]]
                first = i + 1 if within else 0
                if not within and block[i] != part.column("bi")[0].as_py() or first >= n:
                    continue
                mark[mine] = 1
                common = np.add.reduceat(mark[number[starts[first] :]], starts[first:-1] - starts[first])
                mark[mine] = 0
                ok = common >= THRESHOLD * (sizes[i] + sizes[first:] - common) - 1e-9
                if not within:
                    ok &= block != block[i]
                near = np.flatnonzero(ok) + first
                links[i] += len(near)
                docs[i] += copies[near].sum()
                links[near] += 1
                docs[near] += copies[i]
                for j in near.tolist():
                    if sets.join(i, j):
                        for values, x in zip(out, (int(ids[i]), int(ids[j]), 0, 0), strict=True):
                            values.append(x)
            for values, more in zip(out, (ids.tolist(), [None] * n, links.tolist(), docs.tolist()), strict=True):
                values.extend(more)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "other", "links", "docs"])


def _pairs_of_blocks(rows: DataFrame, blocks: str, block: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block is part of."""
    other = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    return other.withColumn("bi", F.least(block, "o")).withColumn("bj", F.greatest(block, "o")).drop("o")


def possible_links(nodes: DataFrame) -> DataFrame:
    """(a, b): edges between nodes (id, labels) whose components hold all pairs found in the forest."""
    shortest = prefix_length()
    prefix = lambda length: F.xxhash64("tree", F.slice("path", 1, length))
    paths = F.array(*[F.struct(F.lit(t).alias("tree"), F.slice("labels", t * DEPTH + 1, DEPTH).alias("path")) for t in range(TREES)])
    keyed = nodes.select("id", F.explode(paths).alias("p")).select("id", "p.*").withColumn("key", prefix(shortest))
    # counts are written before rows meet them, so that both sides of the join are plain and a large trie node's rows can be split
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    members = stored(keyed.join(shared, "key").drop("key"), "members")
    sketched, settled, edges = signed_sketches(nodes), None, None
    for length in range(DEPTH, shortest - 1, -1):
        now = members.withColumn("key", prefix(length))
        now = now.join(settled.withColumn("done", F.lit(True)), "id", "left") if settled is not None else now.withColumn("done", F.lit(None).cast("boolean"))
        now = now.select("id", "key", F.col("done").isNull().alias("open"))
        groups = now.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("any")).where("n > 1 AND any")
        groups = stored(groups.select("key", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")), "groups")
        dealt = now.join(groups, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(sketched, "id")
        dealt = _pairs_of_blocks(dealt, "blocks", "block").select("key", "bi", "bj", "id", "open", "sketch").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        found = stored(dealt.mapInArrow(_possible_links(length), "id bigint, other bigint, links bigint, weight double"), "links")
        more = found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
        edges = more if edges is None else edges.unionByName(more)
        if length > shortest:
            good = found.where("links IS NOT NULL").groupBy("id").agg((F.sum("links") / F.sum("weight")).alias("recall")).where(F.col("recall") >= RECALL).select("id")
            settled = stored(good if settled is None else settled.unionByName(good).distinct(), "settled")
    return edges


def _digest(words: Column) -> Column:
    return F.md5(F.array_join(words, " "))


def _classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, digest, keep, class_id, n_links, n_text_links): classes(), and whether the row is the one of its class that stays."""
    signed = stored(signatures(docs, text, id_col), "signatures")
    # copies have equal labels, whichever comes first; the number of a node is written, so it stays
    nodes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    comps = connected_components(possible_links(nodes.select(F.col("node").alias("id"), "labels")))
    comps = comps.select("node", F.col("label").alias("comp")).join(nodes.select("node", "digest", "copies", "n_shingles"), "node")
    sizes = comps.groupBy("comp").agg(F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_TEXTS)).alias("blocks"))
    comps = stored(comps.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "components")
    # the same join whatever the number of components: the texts go to their nodes, a task's copies of a text as one
    texts = docs.select(_digest(words_of_trimmed(trimmed(whole(text)))).alias("digest"), F.col(text).alias("text"))
    texts = texts.withColumn("nth", F.row_number().over(Window.partitionBy("digest").orderBy("digest"))).where("nth = 1")
    found = texts.join(comps.hint("merge"), "digest").select("comp", F.col("node").alias("id"), "copies", "blocks", "block", words_of_trimmed(trimmed(whole("text"))).alias("words"))
    # in a step of its own: else each place would split the text again
    found = found.select("comp", "id", "copies", "blocks", "block", shingles(F.col("words")).alias("shingles"))
    found = _pairs_of_blocks(found, "blocks", "block").repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "id")
    checked = stored(found.mapInArrow(_verified, "id bigint, other bigint, links bigint, docs bigint"), "verified")
    counts = checked.where("other IS NULL").groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    labels = stored(connected_components(checked.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))), "labels")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    least = stored(labels.join(nodes.select("node", "id", "digest"), "node").groupBy("label").agg(F.min(first).alias("least")), "least")
    linked = nodes.select("node", "id", "digest", "copies").join(labels.join(least, "label").select("node", "least"), "node", "left").join(counts, "node", "left")
    linked = linked.select("digest", F.coalesce("least", first).alias("least"), (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("links", F.lit(0)).cast("long").alias("n_text_links"))
    # texts without words find no partner here: their key is null
    rows = signed.select("id", F.col("digest").alias("own"), F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(linked, "digest", "left")
    stays = F.col("least").isNull() | (F.col("least.id").eqNullSafe(F.col("id")) & (F.col("least.digest") == F.col("own")))
    class_id = F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id"))
    return rows.select("id", F.col("own").alias("digest"), stays.alias("keep"), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"))


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, class_id, n_links, n_text_links), one row for each input row."""
    return _classes(docs, text, id_col).select(F.col("id").alias(id_col), "class_id", "n_links", "n_text_links")


def signed_sketches(nodes: DataFrame) -> DataFrame:
    """(id, sketch): the low byte of each MinHash value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column("labels").flatten().to_numpy(zero_copy_only=False).astype(np.uint32).astype(np.uint8)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(TREES * DEPTH), batch.num_rows, [None, pa.py_buffer(low.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("id"), flat.cast(pa.binary())], ["id", "sketch"])

    return nodes.select("id", "labels").mapInArrow(run, "id bigint, sketch binary")


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each class: that of the least id, of those the one of the least digest. Columns as given; rows that are equal in id and words stay or go together."""
    i, d = (fresh(docs.columns, f"__{x}") for x in ("id", "digest"))
    drop = stored(_classes(docs, text, id_col).where(~F.col("keep")).select(F.col("id").alias(i), F.col("digest").alias(d)).distinct(), "dropped")
    own = _digest(words_of_trimmed(trimmed(whole(docs[text]))))
    return docs.join(drop, docs[id_col].eqNullSafe(F.col(i)) & (own == F.col(d)), "left_anti")
