import re
from collections import Counter

from pointloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def key(r):
    return tuple((x is not None, x) for x in r)


def check(docs):
    want = sorted(((r.doc_id, *measured(r.text)) for r in docs.collect()), key=key)
    got = sorted(((r.doc_id, *(r[m] for m in quality.MEASURES)) for r in quality.ledger(docs).collect()), key=key)
    assert got == want


def test_measures(messy, documents):
    check(messy)
    check(documents)


def test_empty(nothing):
    assert quality.ledger(nothing).count() == 0
    assert quality.keep_good(nothing).columns == nothing.columns
    assert all(not r.rejected for r in quality.ablations(quality.ledger(nothing)).collect())


def test_policies_and_ablations(documents):
    rows = quality.ledger(documents).collect()
    order = {r: k for k, r in enumerate(quality.RULES)}
    for r in quality.ablations(quality.ledger(documents)).collect():
        mask, bit = quality.mask_of(quality.POLICIES[r.policy]), 1 << order[r.rule]
        assert r.rejected == sum(bool(x.failed_rules & mask) for x in rows)
        assert r.failing == sum(bool(x.failed_rules & bit) for x in rows)
        assert r.only_this_rule == sum(x.failed_rules & mask == bit for x in rows)
    kept = {r.doc_id for r in quality.keep_good(documents).collect()}
    assert kept == {r.doc_id for r in rows if r.failed_rules & quality.mask_of(quality.POLICIES[quality.PRODUCTION]) == 0}


def test_keep_good_keeps_columns(messy):
    out = quality.keep_good(messy)
    assert out.columns == messy.columns and {r.doc_id for r in out.collect()} == {6, 7} - {r.doc_id for r in quality.ledger(messy).collect() if r.failed_rules}
