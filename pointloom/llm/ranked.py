"""Ranked lexical search: block-max search over posting lists whose block borders a dynamic program chooses.

1. counted(): each document's number of terms and its counts of the query terms, in
   one pass over whole texts; N, L and document frequencies are aggregates of it.
2. A task turns the documents that it reads into shards of SHARD_DOCS documents or
   SHARD_POSTINGS postings, so no posting is shuffled. In a shard, every term has a
   posting list with its exact integer scores.
3. Variable blocks: over borders at every STEP-th posting and blocks of up to WIDEST
   steps, a dynamic program finds the partition of a list that minimises the bound
   error (block maximum less score, over all postings) plus a price for each block.
   It runs for all lists of a shard side by side.
4. Search: between two borders of any of its terms, a query's score is at most the sum
   of the blocks' maxima. That is the pivot test of WAND, made for all such intervals
   of documents at once: they are opened from the highest bound down, all postings in
   them are added up exactly, and those below the TOP-th score so far are skipped. The
   scores that a task has found go on to its next shard. An interval whose bound equals
   the threshold is opened, for equal scores rank by id.
5. Tasks give TOP rows a query at most; a salted and a final window rank them.

Queries are taken in blocks of about BLOCK_TERMS terms (chosen by hash, from the
number of terms of all items), so what is sent to tasks is bounded; each block is
ranked against all documents.

Defined results: a term is a maximal run of characters other than ASCII ones that
are neither digits nor letters; only A-Z are lower-cased. Null and empty texts have
no terms: such documents count for nothing and such items have no rows. Every row of
items is a query of its own, so repeated items give repeated rows; repeated documents
all rank; null ids rank behind others of the same score; texts of any length are read
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.text import whole
from pointloom.llm.tokens import byte_table, terms_of, text_slices
from pointloom.scratch import stored

#: Fixed value: what a term holds.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
BLOCK_TERMS = 1 << 18
SHARD_DOCS = 1 << 15
SHARD_POSTINGS = 1 << 21
STEP = 8  # postings between possible borders
WIDEST = 16  # steps of a block at most
SALTS = 512

#: Bytes of terms, lower-cased; all other ASCII bytes are separators.
TABLE = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))


def query_blocks(items: DataFrame, text: str, id_col: str, most: int = BLOCK_TERMS) -> Iterator[list[tuple]]:
    """(item id, text) of all items, a bounded block at a time."""
    rows = items.select(F.col(id_col).alias("id"), whole(text).alias("text"))
    terms = rows.agg(F.sum(F.regexp_count("text", F.lit(TERM)).cast("long"))).first()[0] or 0
    blocks = -(-terms // most)
    for k in range(blocks):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()]


def counted(docs: DataFrame, vocabulary: pa.StringArray, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n, terms, tfs): the number of terms of each document that has any, and its counts of the vocabulary's terms, by their place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                t = terms_of(part.column("text"), TABLE)
                place = pc.fill_null(pc.index_in(t.distinct, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                term = place[t.code].astype(np.int64)
                pairs, tf = np.unique((t.row * np.int64(len(vocabulary)) + term)[term >= 0], return_counts=True)
                row, term = np.divmod(pairs, max(len(vocabulary), 1))
                at = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(t.n, pa.int64()), *lists], ["id", "n", "terms", "tfs"]).filter(pa.array(t.n > 0))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<int>")


def borders(scores: np.ndarray, starts: np.ndarray, step: int = STEP, widest: int = WIDEST) -> np.ndarray:
    """First postings of the blocks of all lists: list k holds the scores from starts[k] on, and none is empty.

    The best partition of the first i steps of a list is the cheapest, over the last
    block's width w, of that of i - w steps plus the last block's maximum times its
    postings plus the price of a block; all lists take their i-th step at once.
    """
    ends = np.append(starts[1:], len(scores))
    length = ends - starts
    order = np.argsort(-length, kind="stable")  # lists that still go on come first
    length, starts = length[order], starts[order]
    units = -(-length // step)
    base = np.concatenate([[0], np.cumsum(units)])[:-1]
    unit_list = np.repeat(np.arange(len(units)), units)
    nth = np.arange(len(unit_list)) - base[unit_list]
    first = starts[unit_list] + nth * step
    # maxima of units, in the order of `order`
    by_place = np.argsort(first)
    top = np.empty(len(first), np.int64)
    top[by_place] = np.maximum.reduceat(scores, first[by_place])
    size = np.minimum(step, length[unit_list] - nth * step)
    list_top, list_sum = (f.reduceat(x, base) for f, x in ((np.maximum, top), (np.add, np.concatenate([[0], np.cumsum(scores)])[first + size] - np.concatenate([[0], np.cumsum(scores)])[first])))
    price = step * (list_top - list_sum / length)
    # cost of the block of w units that ends with a unit
    cost = np.full((len(first), widest), np.inf)
    high, held = top.copy(), size.astype(np.int64)
    for w in range(min(widest, int(units.max(initial=0)))):
        if w:
            high[w:] = np.maximum(high[w:], top[:-w])
            held[w:] = held[w:] + size[:-w]
        inside = nth >= w
        cost[inside, w] = (high * held + price[unit_list])[inside]
    best, choice = np.full(len(first), np.inf), np.zeros(len(first), np.int64)
    active = np.searchsorted(-units, -np.arange(1, int(units.max(initial=0)) + 1), side="right")  # lists of i units or more
    for i, a in enumerate(active):
        at = base[:a] + i
        span = min(i + 1, widest)
        before = np.where(np.arange(span) < i, best[np.maximum(at[:, None] - 1 - np.arange(span), 0)], 0.0)
        whole_cost = before + cost[at, :span]
        choice[at] = whole_cost.argmin(1)
        best[at] = whole_cost[np.arange(a), choice[at]]
    out, at = [], base + units - 1
    while len(at):
        begin = at - choice[at]
        out.append(first[begin])
        at = (begin - 1)[nth[begin] > 0]
    return np.sort(np.concatenate([np.empty(0, np.int64), *out]))


class Shard:
    """Posting lists of some documents with their blocks."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, m: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        self.ids, self.known = ids, known
        order = np.argsort(term.astype(np.uint16) if len(weight) <= 1 << 16 else term, kind="stable")  # rows ascend within a term
        self.doc, term, tf = row[order], term[order], tf[order].astype(np.int64)
        self.score = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc]))
        self.at = np.searchsorted(term, np.arange(len(weight) + 1))
        full = self.at[:-1][np.diff(self.at) > 0]
        self.block = borders(self.score, full)
        self.top = np.maximum.reduceat(self.score, self.block) if len(self.block) else self.score
        self.blocks = np.searchsorted(self.block, self.at)  # the first block of each term

    def intervals(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(borders, bounds): between borders[i] and borders[i + 1] no document of the shard scores above bounds[i]."""
        spans = [(self.doc[self.block[a:b]], self.top[a:b] * x) for t, x in zip(terms, times, strict=True) if (a := self.blocks[t]) < (b := self.blocks[t + 1])]
        cuts = np.unique(np.concatenate([[len(self.ids)], *(d for d, _ in spans)]))
        bounds = np.zeros(len(cuts) - 1, np.int64)
        for docs, tops in spans:
            k = np.searchsorted(docs, cuts[:-1], side="right")
            bounds += np.where(k > 0, tops[k - 1], 0)
        return cuts, bounds

    def scores(self, terms: np.ndarray, times: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the documents between first and stop that have one above 0, from the postings there alone."""
        total = np.zeros(len(self.ids), np.int64)
        for t, x in zip(terms, times, strict=True):
            docs = self.doc[self.at[t] : self.at[t + 1]]
            lo, n = np.searchsorted(docs, first), np.searchsorted(docs, stop)
            n -= lo
            inside = self.at[t] + np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            total[self.doc[inside]] += x * self.score[inside]
        rows = np.flatnonzero(total)
        return rows, total[rows]


class Best:
    """The best rows of a query so far: by score, then id, null ids last."""

    def __init__(self, most: int):
        self.most = most
        self.score, self.id, self.known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        score, ids, known = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -score))[: self.most]
        self.score, self.id, self.known = score[order], ids[order], known[order]

    @property
    def threshold(self) -> int:
        """What a row must reach to be ranked."""
        return int(self.score[-1]) if len(self.score) == self.most else 1


def search(shard: Shard, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
    """Opens intervals from the highest bound down until none can matter; the number of documents that were looked at."""
    cuts, bounds = shard.intervals(terms, times)
    order = np.argsort(-bounds, kind="stable")
    low, width = -bounds[order], np.cumsum(np.diff(cuts)[order])
    at, want, looked = 0, 4 * best.most, 0
    while at < len(order):
        able = int(np.searchsorted(low, -best.threshold, side="right"))
        if at >= able:
            break
        stop = min(able, int(np.searchsorted(width, looked + want)) + 1)
        now = np.sort(order[at:stop])
        rows, score = shard.scores(terms, times, cuts[now], cuts[now + 1])
        best.add(score, shard.ids[rows], shard.known[rows])
        at, want, looked = stop, 4 * want, int(width[stop - 1])
    return looked


def _search_all(counts: DataFrame, queries: list[tuple], places: list[tuple], weight: np.ndarray, n_docs: int, n_terms: int, top: int, kind: str) -> DataFrame:
    """(q, item_id, doc_id, score): each task's best rows of each query."""
    names = pa.array([x[0] for x in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = [Best(top) for _ in queries], []

        def close() -> None:
            ids, n, terms, tfs = (pa.concat_arrays([x[k] for x in held]) for k in range(4))
            n = n.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(ids)), np.diff(np.asarray(terms.offsets)))
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (terms, tfs)]
            shard = Shard(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_valid(ids).to_numpy(zero_copy_only=False), 75 + 25 * n * n_docs // n_terms, row, *flat, weight)
            for b, (own, times) in zip(best, places, strict=True):
                search(shard, own, times, b)
            held.clear()

        docs = postings = 0
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                more = len(part.column("terms").flatten())
                if held and (docs + part.num_rows > SHARD_DOCS or postings + more > SHARD_POSTINGS):
                    close()
                    docs = postings = 0
                held.append([part.column(c) for c in ("id", "n", "terms", "tfs")])
                docs, postings = docs + part.num_rows, postings + more
        if held:
            close()
        for q, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), q), pa.int64()), names.take(pa.array(np.full(len(b.score), q))), pa.array(b.id, pa.int64(), mask=~b.known), pa.array(b.score)], ["q", "item_id", "doc_id", "score"])

    return counts.mapInArrow(run, f"q bigint, item_id {kind}, doc_id bigint, score bigint")


def ranking(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item id, rank, doc id, score): the `top` highest-scoring documents of each item."""
    kind = items.schema[item_id].dataType.simpleString()
    found = []
    for queries in query_blocks(items, item_text, item_id, block_terms):
        t = terms_of(pa.array([x[1] for x in queries], pa.string()), TABLE)
        pairs = [np.unique(own, return_counts=True) for own in np.split(t.code, np.searchsorted(t.row, np.arange(1, len(queries))))]
        vocabulary = t.distinct
        counts = stored(counted(docs, vocabulary, text, id_col), "counted")
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        weight = np.full(len(vocabulary), 0, np.int64)
        for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row per term of the block's queries
            weight[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
        found.append(_search_all(counts, queries, pairs, weight, n_docs, n_terms, top, kind).withColumn("block", F.lit(len(found))))
    if not found:
        return docs.sparkSession.createDataFrame([], f"`{item_id}` {kind}, rank int, `{id_col}` bigint, score bigint")
    rows = functools.reduce(DataFrame.unionByName, found).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["block", "q", "salt"], ["block", "q"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return rows.select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(id_col), "score")
