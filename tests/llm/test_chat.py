from collections import defaultdict

from pyspark.sql import functions as F

from pointloom.llm import chat


def brute(rows):
    pairs = defaultdict(lambda: {"chosen": [], "rejected": []})
    for r in rows:
        if r.pair_id is not None and r.side in chat.SIDES:
            pairs[r.pair_id][r.side].append(r)
    out = []
    for pair, sides in pairs.items():
        for s in sides.values():
            s.sort(key=lambda r: [(x is not None, x) for x in (r.turn, r.role, r.text)])
        a, b = ([(r.role, r.text) for r in sides[s]] for s in chat.SIDES)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        for part, turns, first in (("prompt", a[:n], 0), ("chosen", a[n:], n), ("rejected", b[n:], n)):
            at = 0
            for k, (role, text) in enumerate(turns):
                said = f"<|{role if role is not None else 'none'}|>\n{text or ''}<|end|>\n"
                out.append((pair, part, first + k, role, said, at, at + len(said), part != "prompt" and role == "assistant", n))
                at += len(said)
    return sorted(map(str, out))


def test_segments(spark):
    rows = [(1, s, t, r, x) for s, last in (("chosen", "good"), ("rejected", "bad")) for t, r, x in ((0, "system", "be"), (1, "user", "hi"), (2, "assistant", last))]
    rows += [(2, "chosen", 0, "user", "only one side"), (3, "chosen", 0, "user", "same"), (3, "rejected", 0, "user", "same")]
    rows += [(4, "chosen", 0, None, None), (4, "rejected", 0, None, None), (4, "rejected", 0, None, None), (4, "rejected", None, "assistant", "é" * 50_000), (None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x")]
    rows += [(7, s, t, "user", f"turn {t}") for s in chat.SIDES for t in (None, -500, -64, -1, 0, 63, 64, 1 << 40)] + [(8, "chosen", 1, None, "x"), (8, "rejected", 1, "none", "x"), (8, "rejected", 1, None, None)]
    rows += [(6, s, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 250 else s) for s in chat.SIDES for t in range(300)]
    df = spark.createDataFrame(rows, "pair_id bigint, side string, turn bigint, role string, text string").selectExpr("*", "1 AS place", "'x' AS part")
    assert sorted(str(tuple(r)) for r in chat.segments(chat.of_sides(df)).collect()) == brute(df.collect())
    one = {r.pair_id: r for r in chat.assembled(chat.segments(chat.of_sides(df))).collect()}
    assert one[1].prompt == "<|system|>\nbe<|end|>\n<|user|>\nhi<|end|>\n" and one[1].chosen == "<|assistant|>\ngood<|end|>\n"
    assert [tuple(m) for m in one[1].rejected_mask] == [(0, len(one[1].rejected))] and one[3].chosen == one[3].rejected == ""
    assert {r.pair_id for r in chat.assembled(chat.segments(chat.of_sides(df)), 10_000).collect()} == set(one) - {4}  # pair 4 is longer and stays in turns
    assert chat.segments(chat.of_sides(df.limit(0))).count() == 0


def test_conversations(spark):
    df = chat.pairs_of_neighbours(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    sides = [df.where(s).withColumn("side", F.lit(s)) for s in chat.SIDES]
    rows = chat.segments(df).collect()
    assert sorted(str(tuple(r)) for r in rows) == brute(sides[0].unionByName(sides[1]).collect())
    assert len({r.n_prompt for r in rows}) > 2  # prefixes end at different turns


def test_both_sides_in_one_row(spark):
    """A turn that comes once for both sides is the same as one for each."""
    flags = [(1, True, True, t, "user", f"t{t}") for t in range(5)] + [(1, True, False, 2, "user", "t"), (1, True, True, 9, "assistant", None), (2, True, True, None, None, None), (2, True, True, None, None, None)]
    df = spark.createDataFrame(flags, "pair_id bigint, chosen boolean, rejected boolean, turn bigint, role string, text string")
    sides = [df.where(s).withColumn("side", F.lit(s)) for s in chat.SIDES]
    both = sides[0].unionByName(sides[1])
    want = brute(both.collect())
    assert sorted(str(tuple(r)) for r in chat.segments(df).collect()) == want
    assert sorted(str(tuple(r)) for r in chat.segments(chat.of_sides(both)).collect()) == want
