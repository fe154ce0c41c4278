import random
import re

from pointloom.llm import near


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(r.doc_id, shingle_set(r.text), tuple((r.text or "").split())) for r in rows]
    n = len(sets)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links, texts = [0] * n, [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                if sets[i][2] != sets[j][2]:
                    texts[i].add(sets[j][2])
                    texts[j].add(sets[i][2])
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i in range(n):
        if sets[i][0] is not None:
            least[find(i)] = min(least.get(find(i), sets[i][0]), sets[i][0])
    return sorted(str((sets[i][0], least.get(find(i)) if sets[i][1] else sets[i][0], links[i], len(texts[i]))) for i in range(n))


def got(docs):
    return sorted(str((r.doc_id, r.class_id, r.n_links, r.n_text_links)) for r in near.classes(docs).collect())


def test_messy(messy):
    assert got(messy) == brute(messy.collect())


def test_documents(documents):
    assert got(documents) == brute(documents.collect())


def test_empty(nothing):
    assert got(nothing) == [] and near.one_of_each(nothing).columns == nothing.columns


def test_rows_that_share_an_id(spark):
    """Texts under one id or none keep their own links and classes, and the row that stays is chosen by text."""
    words = lambda k: [f"t{k}w{i}" for i in range(60)]
    near_copy = lambda k: " ".join([*words(k)[:59], "other"])
    rows = [(1, " ".join(words(0))), (1, " ".join(words(1))), (2, near_copy(0)), (3, near_copy(1)), (None, " ".join(words(2))), (None, near_copy(2)), (None, near_copy(0)), (3, "alone under three"), (4, near_copy(1) + " "), (1, " ".join(words(0)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(docs) == brute(docs.collect())
    kept = [(r.doc_id, r.text) for r in near.one_of_each(docs).collect()]
    assert sorted(k for k in kept if k[0] is not None) == sorted([rows[0], rows[9], rows[1], rows[7]])
    assert len([k for k in kept if k[0] is None]) == 1 and [k for k in kept if k[0] is None][0] in rows[4:6]


def test_one_large_group_in_blocks(spark, monkeypatch):
    """Copies with a few changed words, around the threshold, dealt over many blocks."""
    monkeypatch.setattr(near, "BLOCK_ROWS", 16)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 4000)
    monkeypatch.setattr(near, "BLOCK_TEXTS", 50)
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(r.randrange(6)):
            words[r.randrange(150)] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(docs) == brute(docs.collect())
    kept = {x.doc_id for x in near.one_of_each(docs).collect()}
    assert kept == {x.class_id for x in near.classes(docs).collect()}


def test_prefix_length_meets_the_recall():
    k = near.prefix_length()
    assert 1 - (1 - near.THRESHOLD**k) ** near.TREES >= near.RECALL > 1 - (1 - near.THRESHOLD ** (k + 1)) ** near.TREES
