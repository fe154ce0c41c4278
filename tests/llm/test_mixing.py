import functools
import math
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from pointloom.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """By rounds: whatever is above its cap stops there and the excess goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def check(docs):
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    want, took = targets(sizes), defaultdict(int)
    got = mixing.taken(docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r.doc_id), size(r.text)) for r in rows)
    where = {r.doc_id: r.source for r in rows}
    for r in got:
        assert r.source_size == sizes[where[r.doc_id]] and r.target == pytest.approx(want[where[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size
        took[where[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(took[s] - want[s]) <= 2 * mixing.BLOCK + mixing.TOLERANCE * want[s]
    again = mixing.taken(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix(messy, documents):
    check(messy)
    check(documents)


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).collect()]
        assert sorted(got) == list(range(n)) and (n < 7 or got != sorted(got))


def drawn_by_hand(targets, seed=0):
    """(per source: blocks, quota), counts of each shard, final draws of each source: the same draw in plain Python."""
    per = {r.source_no: (-(-r.source_size // mixing.BLOCK), r.target, r.source_size) for r in targets.collect() if r.source_size}
    quota = {s: math.floor(t * n / w + 0.5) for s, (n, t, w) in sorted(per.items())}
    quota = {s: q for s, q in quota.items() if q}
    line = [s for s, q in quota.items() for _ in range(q)]
    hashed = lambda *x: functools.reduce(lambda h, y: xxhash.xxh64_intdigest(struct.pack("<q", y), h), x, 42)
    shards = defaultdict(Counter)
    for place in range(len(line)):
        u = hashed(seed, place)
        shards[place // mixing.SHARD_SLOTS][line[(u - (1 << 64) * (u >> 63)) % len(line)]] += 1
    drawn = sum(shards.values(), Counter())
    low = {s: math.ceil(q * (1 - mixing.TOLERANCE)) for s, q in quota.items()}
    high = {s: min(math.floor(q * (1 + mixing.TOLERANCE)), max(q, 2 * per[s][0])) for s, q in quota.items()}
    final = {s: min(max(drawn[s], low[s]), high[s]) for s in quota}
    while sum(final.values()) < len(line):
        final[next(s for s in final if final[s] < high[s])] += 1
    while sum(final.values()) > len(line):
        final[next(s for s in final if final[s] > low[s])] -= 1
    return {s: per[s][0] for s in quota}, shards, final


def test_draw_against_plain_python(documents, messy, monkeypatch):
    """Each shard's counts are its own multinomial draw; what is taken follows the slots, and the slots the draw."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 256)
    for docs in (documents, messy):
        t = mixing.source_targets(mixing.placed(docs).select("source", "size"))
        blocks, shards, final = drawn_by_hand(t)
        per = mixing.quotas(t)
        n_slots = sum(final.values())
        got = defaultdict(Counter)
        for r in mixing.counts(per, n_slots, per.count()).collect():
            got[r.shard][r.source_no] += r.n
        assert got == shards
        drawn = mixing.slots(t).collect()
        assert sorted(r.shard * 256 + r.slot for r in drawn) == list(range(n_slots))
        assert Counter(r.source_no for r in drawn) == Counter(final)
        times = Counter((r.source_no, r.block_no) for r in drawn)
        for s, n in blocks.items():
            assert Counter(times[s, b] for b in range(n)) == Counter({final[s] // n: n - final[s] % n, final[s] // n + 1: final[s] % n} if final[s] % n else {final[s] // n: n})
        assert docs is messy or len({tuple(sorted(x.items())) for x in shards.values()}) == len(shards)


def test_another_draw_takes_other_words(documents):
    """The counts that shards draw reach the result: with another seed sources take other numbers of words."""
    took = []
    for seed in (0, 1):
        per = defaultdict(int)
        for r in mixing.taken_rows(documents, seed=seed).collect():
            per[r.source] += r.taken
        took.append(per)
    assert took[0] != took[1]


def test_packed_blocks_hold_the_words_taken(messy, documents):
    for docs in (messy, documents):
        rows = docs.collect()
        said = Counter(w for r in mixing.packed(docs).collect() for w in re.findall(r"[^\x20\x09-\x0D]+", r.text))
        sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixing.packed(docs).collect()]
        assert max(sizes) <= mixing.BLOCK and sum(sizes) == sum(r.taken for r in mixing.taken(docs).collect())
        have = Counter(w for r in rows for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert all(n <= 2 * have[w] for w, n in said.items())


def test_empty(nothing):
    assert mixing.taken(nothing).count() == 0
    assert mixing.mixed(nothing).columns == nothing.columns


def test_mixed_keeps_columns(messy):
    out = mixing.mixed(messy)
    assert out.columns == messy.columns and all(size(r.text) for r in out.collect())


def test_rows_without_id_are_decided_apart(spark):
    """Of two sources whose rows have no ids, the one that the mix takes twice comes twice and the other, with an empty text, as its own target says."""
    rows = [(None, f"{s} {i} " + "word " * 62, s) for s, n in (("a", 20), ("b", 200)) for i in range(n)] + [(None, "", "a")]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    took = {s: sum(r.source == s for r in out) for s in "ab"}
    want = targets({s: sum(size(t) for _, t, x in rows if x == s) for s in "ab"})
    assert took["a"] == 40 and all(r.text for r in out)
    assert abs(took["b"] * 64 - want["b"]) < 0.15 * want["b"] and len({r.text for r in out}) > 150
