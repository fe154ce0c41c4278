import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from pointloom.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    out = []
    for body, members in groups.items():
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        for r in members:
            out.append((r.doc_id, best.doc_id, len(members), hashlib.sha256(body.encode()).hexdigest()))
    return out


def check(docs, **how):
    got = exact.groups(docs, **how).collect()
    assert sorted(map(str, brute(docs.collect()))) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_groups(messy, documents):
    check(messy)
    check(documents)


def test_digests_that_collide(messy, documents):
    weak = lambda c: (F.char_length(c) % 3).cast("string")
    check(messy, digest=weak, compare_members=True)
    check(documents, digest=weak, compare_members=True)


def test_extreme_ids(spark):
    check(spark.createDataFrame([(2**63 - 1, "a b"), (-(2**63), "ab "), (None, "a b"), (0, "a b")], "doc_id bigint, text string"))


def test_deduplicated(messy, documents, nothing):
    for docs in (messy, documents):
        out = exact.deduplicated(docs)
        want = {(r.doc_id, r.text_sha256) for r in exact.groups(docs).collect() if r.kept}
        assert out.columns == docs.columns and out.count() == len(want)
        assert {r.doc_id for r in out.collect()} == {x[0] for x in want}
    assert exact.deduplicated(nothing).count() == 0 and exact.groups(nothing).count() == 0
