import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from pointloom.llm import sharding


def brute(items, capacity):
    """Bin of each item, one by one in the given order."""
    rooms, placed = [], []
    for size in items:
        fits = [(room, k) for k, room in enumerate(rooms) if room >= size]
        k = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(max(capacity, size))
        rooms[k] -= size
        placed.append(k)
    return placed


def histogram(items):
    return sorted(Counter(items).items(), reverse=True)


def one_by_one(runs):
    """Bins of all groups in decreasing size, by rank."""
    return [first_bin + k // each for _, _, n, first_bin, each in sorted(runs, key=lambda r: (-r[0], r[1])) for k in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    r = random.Random(seed)
    items = sorted((r.randint(1, 900) if r.random() < 0.7 else r.choice([5, 90, 300]) for _ in range(700)), reverse=True)
    assert one_by_one(sharding.best_fit(histogram(items), 800)) == brute(items, 800)
    assert one_by_one(sharding.best_fit(histogram(items), 1)) == list(range(700))
    assert sharding.best_fit(histogram(items), 1000, bins=10) is None
    weights = Counter()
    for b, size in zip(one_by_one(sharding.equal_bins(histogram(items), 8)), items, strict=True):
        weights[b] += size
    assert max(weights.values()) - min(weights.values()) <= 20 and len(weights) == 8


def test_documents_are_packed_as_groups(messy, documents):
    """Shards of whole tables against packing the groups one by one."""
    for docs in (messy, documents):
        for capacity in (9_000, 60_000):
            rows = docs.collect()
            groups = Counter()
            for r in rows:
                groups[r.text or ""] += len((r.text or "").encode()) + 8
            order = sorted(groups, key=lambda t: (-groups[t], hashlib.sha256(t.encode()).digest()))
            want = Counter((b, groups[t]) for b, t in zip(brute([groups[t] for t in order], capacity), order, strict=True))
            got, texts = set(), {(zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8): r.text or "" for r in rows}
            for r in sharding.sharded(docs, capacity=capacity).collect():
                got.add((r.shard, texts[r.text_crc32, r.size]))
            assert len(got) == len(groups) and Counter((b, groups[t]) for b, t in got) == want


def check(docs, **how):
    rows = docs.collect()
    got = sharding.sharded(docs, **how).collect()
    want = sorted(str((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))) for r in rows)
    assert want == sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got)
    slots, shard_of, weight = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        shard_of[r.text_crc32].add(r.shard)
        weight[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shard_of.values())
    return weight


def test_shards(messy, documents, nothing):
    check(messy)
    weight = check(documents)
    assert set(weight) <= set(range(24)) and max(weight.values()) - min(weight.values()) < 0.02 * max(weight.values())
    check(nothing)


def test_fixed_capacity(documents):
    weight = check(documents, capacity=60_000)
    assert max(weight.values()) <= 60_000 and len(weight) <= sum(weight.values()) / 60_000 + 2
