import math
import re
from collections import Counter

import numpy as np
import pytest

from pointloom.llm import ranked

ITEMS = "item_id bigint, text string, rank int, score string"


def terms(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(ranked.TERM, low)


def brute(docs, items, top=20):
    """Every score, document by document."""
    counts = [(r.doc_id, Counter(terms(r.text))) for r in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    total, df = sum(n for *_, n in counts), Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item in items:
        scored = []
        for i, c, n in counts:
            m = 75 + (25 * n * len(counts)) // total
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(item.text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(str(item.item_id), k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_messy(spark, messy, nothing):
    items = spark.createDataFrame([(1, "Alpha BETA zeta", 1, "x"), (1, "Alpha BETA zeta", 1, "x"), (2, None, None, None), (3, "", 1, "y"), (None, "text id ID without", 1, "y"), (4, "word1 word2 word1 word996 nowhere", 1, "y"), (5, "日本語 é́ß mark seven last", 1, "y"), (6, "...", 1, "y")], ITEMS)
    assert rows_of(ranked.ranking(messy.repartition(4), items)) == brute(messy.collect(), items.collect())
    assert ranked.ranking(nothing, items).count() == 0 and ranked.ranking(messy, items.where("false")).count() == 0
    assert ranked.ranking(nothing, items).columns == ranked.ranking(messy, items).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("shard_docs", [1 << 15, 30])
def test_documents(spark, documents, monkeypatch, shard_docs):
    """Whatever the shards and the blocks of queries, the rows are those of brute force."""
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute(documents.collect(), items.collect())
    monkeypatch.setattr(ranked, "SHARD_DOCS", shard_docs)
    assert rows_of(ranked.ranking(documents.repartition(2), items, block_terms=1 << 18 if shard_docs > 30 else 300)) == want


def test_hot_copies(spark):
    """A third of the documents are one text; equal scores rank by id."""
    rows = [(i, "common rare words" if i % 3 == 0 else f"common filler w{i % 7}", None, None, None, None, None, None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size int, n_words string").repartition(7)
    items = spark.createDataFrame([(1, "common", 1, "x"), (2, "rare words", 1, "x"), (3, "w3", 1, "x")], ITEMS)
    found = rows_of(ranked.ranking(docs, items))
    assert found == brute(docs.collect(), items.collect())
    assert [r[2] for r in sorted(found, key=lambda r: r[1]) if r[0] == "2"] == list(range(0, 60, 3))


def partition_cost(scores, cuts):
    price = ranked.STEP * (max(scores) - sum(scores) / len(scores))
    return sum(max(scores[a:b]) * (b - a) + price for a, b in zip(cuts, [*cuts[1:], len(scores)], strict=True))


def test_borders_are_the_cheapest():
    """The dynamic program against a plain one, list by list."""
    rng = np.random.default_rng(11)
    lists = [rng.integers(1, 1000, n) for n in (1, 7, 8, 9, 40, 129, 300, 64)] + [np.full(200, 5), np.repeat([1, 900, 3], 48)]
    starts = np.cumsum([0, *map(len, lists)])[:-1]
    got = ranked.borders(np.concatenate(lists).astype(np.int64), starts)
    for a, own in zip(starts, lists, strict=True):
        own, units = own.tolist(), -(-len(own) // ranked.STEP)
        price = ranked.STEP * (max(own) - sum(own) / len(own))
        best = [0.0]
        for i in range(1, units + 1):
            best.append(min(best[j] + max(own[j * ranked.STEP : i * ranked.STEP]) * (min(i * ranked.STEP, len(own)) - j * ranked.STEP) + price for j in range(max(0, i - ranked.WIDEST), i)))
        cuts = [int(x - a) for x in got if a <= x < a + len(own)]
        assert cuts[0] == 0 and all(c % ranked.STEP == 0 for c in cuts)
        assert partition_cost(own, cuts) == pytest.approx(best[-1])


def test_blocks_are_skipped():
    """Of a shard whose good documents stand together, few are looked at, and the best are right."""
    rng = np.random.default_rng(2)
    n = 20_000
    tf = np.where((np.arange(n) > 7000) & (np.arange(n) < 7200), rng.integers(20, 60, n), rng.integers(1, 4, n))
    row = np.concatenate([np.arange(n), np.arange(0, n, 3)])
    term = np.repeat([0, 1], [n, len(range(0, n, 3))])
    tf = np.concatenate([tf, np.ones(len(row) - n, np.int64)])
    shard = ranked.Shard(np.arange(n), np.ones(n, bool), np.full(n, 100), row, term, tf, np.array([500, 2000]))
    best = ranked.Best(20)
    looked = ranked.search(shard, np.array([0, 1]), np.array([1, 1]), best)
    total = np.bincount(shard.doc, shard.score, n)
    order = np.lexsort((np.arange(n), -total))[:20]
    assert (best.id == order).all() and (best.score == total[order]).all() and looked < n / 10
