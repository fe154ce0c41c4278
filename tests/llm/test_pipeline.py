import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest

from pointloom.llm import pieces, quality
from tests.llm.test_mixing import size, targets
from tests.llm.test_near import shingle_set
from tests.llm.test_quality import measured

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def good(rows):
    """Rows that the production policy keeps."""
    for r in rows:
        n, chars, symbols, dup, rep = measured(r.text)
        lines = sum(bool(size(x)) for x in (r.text or "").split("\n"))
        if not (n < 50 or 100 * rep > 50 * n or 4 * symbols > n or 10 * dup > 3 * lines or 2 * chars < 3 * n or chars > 30 * n):
            yield r


def best_of_equal(rows):
    """(doc_id, text) of the row that stays of each group of equal texts."""
    best = {}
    for r in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[body] = min(best.get(body, r), r, key=lambda x: (-len(x.text or ""), x.doc_id is None, x.doc_id or 0))
    return [(r.doc_id, r.text) for r in best.values()]


def least_of_class(rows):
    """Ids of the documents that stay of each class of near-duplicates, among those with an id."""
    sets = {r.doc_id: shingle_set(r.text) for r in rows if r.doc_id is not None}
    classes = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and classes[a] is not classes[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                classes[a] |= classes[b]
                for x in classes[b]:
                    classes[x] = classes[a]
    return {min(c) for c in classes.values()}


def hold(name, before, after):
    """What must be so of any stage's rows on any table, the last stage's too."""
    if name == "quality_rules":
        assert sorted(after, key=str) == sorted(good(before), key=str)
    elif name == "exact_dedup":
        assert sorted(((r.doc_id, r.text) for r in after), key=str) == sorted(best_of_equal(before), key=str) and set(map(str, after)) <= set(map(str, before))
    elif name == "ngram_join":
        stay = least_of_class(before)
        assert sorted(after, key=str) == sorted((r for r in before if r.doc_id is None or r.doc_id in stay), key=str)
    elif name == "source_mixing":
        there, took = Counter(map(str, before)), Counter(map(str, after))
        assert all(n <= 2 * there[r] for r, n in took.items()) and all(size(r.text) for r in after)
    else:
        sp = pieces.processor(public_tokenizers.path("piece_bpe_32k.model"))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = []
        for r in before:
            ids = sp.encode(r.text or "")
            want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
        assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after), key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def rough(spark):
    """Texts that pass the rules, with nulls in any column, copies, near copies, ties, repeated rows, a very long text and columns named like those of the stages."""
    say = lambda k, n=70: [f"word{k}x{i}" for i in range(n)]
    near = say(1)
    near[35] = "another"
    rows = [
        (0, " ".join(say(0)), "en", "a"),
        (1, " ".join(say(1, 300)), "en", "a"),
        (2, "\n".join(say(1, 300)), None, None),  # equal but for white space
        (3, " ".join([*say(1, 300)[:150], "another", *say(1, 300)[151:]]), "en", "b"),  # a near copy
        (4, " ".join(say(4)), None, "b"),
        (4, " ".join(say(4)), None, "b"),  # a repeated row
        (5, " ".join(say(4)), "fr", "b"),  # a tie in length
        (None, " ".join(say(6)), "en", None),
        (None, " ".join(say(7)), None, None),
        (8, None, "en", "a"),
        (9, "", None, "c"),
        (10, " ".join(say(10, 30_000)), "en", "c"),
        (11, " ".join(say(11)) + "  \t é 日本語 ▁mark", "xx", "é"),
        (12, " ".join(near), None, "a"),
    ]
    rows = [(*r, k if k % 3 else None, k % 2 == 0, "x", None) for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words int, kept boolean, class_id string, __times string")


def test_stages_on_rough_tables(spark, rough, messy, nothing):
    """Every stage alone on each table, and one after another on the first."""
    for docs in (rough, messy, nothing):
        before = docs.collect()
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            assert name == "sentencepiece" or after.schema.simpleString() == docs.schema.simpleString()
            hold(name, before, after.collect())
    docs, left = rough, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        after = stage(spark, docs, SF)
        rows = after.collect()
        hold(name, before, rows)
        left.append({r.doc_id for r in rows})
        docs = spark.createDataFrame(rows, after.schema)
    assert left[0] == {0, 1, 2, 3, 4, 5, None, 10, 11, 12} and left[1] == {0, 1, 3, 4, None, 10, 11, 12} and left[2] == left[1] - {3}
    assert left[3] == left[4] != set()


def test_stages_against_brute_force(spark):
    """Each stage's rows on its predecessor's, by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = docs.collect()
        assert docs.columns == columns
        hold(name, before, after)
        if name == "quality_rules":
            assert set(quality.RULES) == set(quality.POLICIES[quality.PRODUCTION])
        elif name == "source_mixing":
            texts, times = {r.doc_id: r for r in before}, Counter(r.doc_id for r in after)
            assert all(texts[r.doc_id] == r for r in after) and max(times.values()) <= 2
            sizes, took = Counter(), Counter()
            for r in before:
                sizes[r.source] += size(r.text)
                took[r.source] += size(r.text) * times[r.doc_id]
            want = targets(sizes)
            assert sum(took.values()) == pytest.approx(sum(want.values()), rel=0.15)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sp = pieces.processor(public_tokenizers.path("piece_bpe_32k.model"))
    assert rows and corpus_pipeline.ORACLE_SQL is None
    for r in rows:
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert sorted(map(str, rows)) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
