import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pointloom.llm import mixer
from pointloom.llm.queries import QUERIES


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), mixer.END]


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def brute(rows):
    """Everything but the model: counts, and the score of single tokens."""
    counts = Counter(t for r in rows if fold(r.doc_id) != 1 for t in tokens(r.text))
    n = sum(counts.values())
    of = math.log10(n + 0.5 * (len(counts) + 1))
    out = []
    for r in rows:
        own = tokens(r.text)
        out.append((str(r.doc_id), fold(r.doc_id) == 1, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10(counts[t] + 0.5) - of for t in own), sum(len(t.encode()) + 1 for t in own) - 1))
    return sorted(out)


def same(df, rows):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.n_bytes) for r in df)
    want = brute(rows)
    assert [g[:5] + g[6:] for g in got] == [w[:5] + w[6:] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9, abs=1e-9)
    for r in df:
        assert r.score < 0 and r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / r.n_bytes)


@pytest.mark.parametrize("frequent", [1 << 20, 20])
def test_counts_and_base(messy, nothing, frequent):
    """Both ways in which a text meets its words give the same; nothing gives nothing."""
    same(mixer.scored(messy.repartition(4), frequent=frequent).collect(), messy.collect())
    empty = mixer.scored(nothing)
    assert empty.count() == 0 and empty.columns[0] == "doc_id"


def test_both_ways_score_alike(documents):
    docs = documents.limit(120).cache()
    a, b = ({r.doc_id: r.score for r in mixer.scored(docs, frequent=f).collect()} for f in (1 << 20, 50))
    assert a == pytest.approx(b, rel=1e-6)


def test_held_out_accuracy(spark):
    """Bits per byte of held-out texts are far below those of bytes by their frequency; with enough texts to learn from, their probability is above that of single tokens, which pays for no spelling."""
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op12_mixing_scores"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    same(rows, docs)
    held = [r for r in rows if r.held_out]
    text = {r.doc_id: "".join(t + " " for t in tokens(r.text)[:-1]) + mixer.END for r in docs}
    seen = Counter(b for r in docs if fold(r.doc_id) != 1 for b in text[r.doc_id].encode())
    total = sum(seen.values()) + 256
    plain = sum(-math.log2((seen[b] + 1) / total) for r in held for b in text[r.doc_id].encode())
    assert sum(r.bits_per_byte * r.n_bytes for r in held) < 0.6 * plain
    more = QUERIES["op12_mixing_scores"](spark, "/root/testdata/sf0.1").where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert more["sum(score)"] > more["sum(base_score)"]


def trained():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(["ba", "re", "tion", "ly", "é"], 3)) for _ in range(300)]
    counts = rng.integers(1, 50, 300)
    words = ["0" + w for w in words]
    bits, table = mixer.Bits(pa.array(words), 14), np.zeros((1 << 14, 2), np.int64)
    for b in range(8):
        for slot in bits.slots(b):
            np.add.at(table, (slot, bits.value(b)), counts[bits.word])
    p = (table[:, 1] + 0.1) / (table.sum(1) + 0.2)
    data = np.rint(np.clip(np.log(p / (1 - p)), -12, 12) * mixer.FINE).astype("<i2").tobytes() + np.minimum(15, np.ceil(np.log2(table.sum(1) + 1))).astype(np.uint8).tobytes()
    return mixer.Tables(14, [(0, data)]), words, counts


def test_probabilities_sum_to_one():
    """The first byte of a word, over all 256 values, and a byte after a beginning."""
    tables, words, counts = trained()
    mix = mixer.Mix()
    for start in (b"", b"ba", b"xyz"):
        bits = mixer.Bits(pa.array(["0x"] * 256), 14)  # replaced below: all values of one byte
        bits.byte = np.concatenate([np.frombuffer(start + bytes([v]), np.uint8) for v in range(256)])
        n = len(start) + 1
        single = mixer.Bits(pa.array(["0" + start.decode() + "x"]), 14)
        bits.contexts = [np.tile(c[:n], 256) for c in single.contexts]
        cost = np.zeros(256 * n)
        for b in range(8):
            p = mix.predict(*tables.inputs(bits, b, slice(None)), b)[0]
            cost -= np.log2(np.where(bits.value(b) == 1, p, 1 - p))
        assert (2.0 ** -cost[n - 1 :: n]).sum() == pytest.approx(1, abs=1e-9)


def test_mixing_learns():
    """Learning closes a quarter and more of the gap between the cost of the words and their entropy; a known word costs less than a strange one."""
    tables, words, counts = trained()
    mix, bits = mixer.Mix(), mixer.Bits(pa.array(words), 14)
    before = (mixer.word_bits(pa.array(words), tables, mix) * counts).sum()
    for _ in range(20):
        for b in range(8):
            mix.learn(*tables.inputs(bits, b, slice(None)), b, bits.value(b), counts[bits.word].astype(float))
    after = mixer.word_bits(pa.array([*words, "0qqqqqqq"]), tables, mix)
    own = Counter()
    for w, n in zip(words, counts.tolist(), strict=True):
        own[w] += n
    entropy = -sum(n * math.log2(n / sum(own.values())) for n in own.values())
    assert entropy < (after[:-1] * counts).sum() < before - 0.25 * (before - entropy) and after[-1] > after[:-1].max()


def test_contexts_stay_in_the_word():
    """A word's cost does not depend on the words beside it, nor on how slices fall."""
    tables, words, _ = trained()
    mix = mixer.Mix()
    apart = [mixer.word_bits(pa.array([w]), tables, mix)[0] for w in words[:50]]
    assert np.allclose(mixer.word_bits(pa.array(words), tables, mix)[:50], apart)


def test_joints_follow_the_text():
    """Each word's joint is made of its class, the three bytes before the space before it and its first four, whatever words they are of."""
    texts = ["", "a", "a b cd efg hijklm", " x  yz\tw ", "é ünd 漢字 a", "A longer A text", "q\x00 \x00"]
    t = mixer.terms_of(pa.array(texts), mixer.TABLE)
    of = np.arange(len(texts)) % mixer.CLASSES
    joints, row = mixer.joints_of(t, of)
    want = []
    for k, text in enumerate(texts):
        before = b"    "
        for w in tokens(text):
            w = w.encode() + (b"" if w == mixer.END else b" ")
            want.append((k, str(of[k]).encode() + before[-4:-1] + w[:4].ljust(4)))
            before += w
    assert sorted(zip(row.tolist(), (int(j).to_bytes(8, "big") for j in joints), strict=True)) == sorted(want)


def test_joints_and_words_make_the_text():
    """The bytes of a joint and of its word behind it are those of the word, in the same contexts as far as these lie within it; over all values of a byte the probabilities sum to one."""
    words = ["a", "ab", "abc", "abcd", "abcdefg", "dé漢"]
    t = mixer.terms_of(pa.array([" ".join(words)]), mixer.TABLE)
    joints, _ = mixer.joints_of(t, np.zeros(1, np.int64))
    head, body, whole = mixer.Bits.of_joints(joints, 14), mixer.Bits(pa.array(["0" + w for w in words]), 14, mixer.HEAD), mixer.Bits(pa.array(["0" + w for w in words]), 14)
    for k, w in enumerate(words):
        assert head.byte[head.word == k].tobytes() + body.byte[body.word == k].tobytes() == w.encode() + b" "
        for c in (4, 5):
            assert np.append(head.contexts[c][head.word == k], body.contexts[c][body.word == k]).tolist() == whole.contexts[c][whole.word == k].tolist()
    assert head.byte[head.word == len(words)].tobytes() == mixer.END.encode()
    tables, mix = trained()[0], mixer.Mix()
    heads = np.array([int.from_bytes(b"0and" + bytes([v]) + b"   ", "big") for v in range(256) if v not in (10, 32)])
    first = mixer.Bits.of_joints(heads, 14)
    first.byte = np.arange(256, dtype=np.uint8)
    first.contexts = [np.full(256, c[0]) for c in first.contexts]
    first.word = np.arange(256)
    assert (2.0 ** -mixer.cost_of(first, 256, tables, mix)).sum() == pytest.approx(1, abs=1e-9)


def test_words_are_predicted_from_those_before(spark):
    """Two held-out texts of the same words: the one in the order of the training texts is the likelier."""
    rng = np.random.default_rng(8)
    follow = {a: b for a, b in zip(["river", "stone", "candle", "window", "garden", "paper"], ["quickly", "zebra", "velvet", "jumps", "under", "mixed"], strict=True)}
    pairs = list(follow.items())
    ids = [k for k in range(3000) if fold(k) != 1][:600]
    rows = [(k, " ".join(w for i in rng.integers(0, 6, 12) for w in pairs[i])) for k in ids]
    held = [k for k in range(4000, 5000) if fold(k) == 1][:2]
    rows += [(held[0], " ".join(w for p in pairs for w in p)), (held[1], " ".join(w for a, (_, b) in zip(follow, pairs[1:] + pairs[:1], strict=True) for w in (a, b)))]
    got = {r.doc_id: r for r in mixer.scored(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()}
    assert sorted(tokens(rows[-1][1])) == sorted(tokens(rows[-2][1]))
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 3


def test_bits_of_half_a_byte_share_sixteen_slots():
    """Each context is hashed once for four bits: their slots differ and lie in one run of 16; given the hashes or not, they are the same."""
    bits = mixer.Bits(pa.array(["0river", "3stone", "7é漢字"]), 14)
    for half in range(2):
        slots = np.array([list(bits.slots(b)) for b in range(4 * half, 4 * half + 4)])
        assert (slots >> 4 == slots[0] >> 4).all() and (slots != slots[0])[1:].all()
        assert (slots == [list(bits.slots(b, halves=bits.halves(half))) for b in range(4 * half, 4 * half + 4)]).all()
    # the 15 beginnings of half a byte have a slot each
    bits.byte = np.arange(16, dtype=np.uint8)[:15]
    bits.contexts = [np.full(15, c[0]) for c in bits.contexts]
    assert len({(int(s), int(n)) for b in range(4, 8) for s, n in zip(next(bits.slots(b)), bits.node(b), strict=True)}) == len({int(s) for b in range(4, 8) for s in next(bits.slots(b))}) == 15


def test_zero_says_that_nothing_was_counted(spark):
    """A slot with as many ones as zeros is told from an empty one by its stretched probability alone."""
    rows = [(f"0x{c}", None, 3, 3, 0) for c in "pqrs"]
    found = mixer.bit_tables(spark.createDataFrame(rows, "word string, joint bigint, n_all bigint, n_train bigint, n_tune bigint"), 10).collect()
    tables = mixer.Tables(10, [(r.chunk, bytes(r.slots)) for r in found])
    assert (tables.stretched[tables.size > 0] != 0).all() and (tables.stretched[tables.size == 0] == 0).all()
