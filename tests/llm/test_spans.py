import hashlib
import math
import random
import re
from collections import Counter

import regex
import zstandard
from pyspark.sql import functions as F

from pointloom.llm import pii, secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def written(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def noise(seed, alphabet, n=400):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 120))) for _ in range(n)]


def as_docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def check(docs, digests, base, kinds, counts):
    rows = docs.collect()
    got = sorted(digests(docs).collect(), key=str)
    want = sorted((str(r.doc_id), [sum(s[1] == k for s in base(r.text or "")) for k in range(counts)], hashlib.sha256(written(base(r.text or ""), kinds).encode()).hexdigest()) for r in rows)
    assert want == sorted((str(r.doc_id), [r[f"n_{k}"] for k in kinds[:counts]], r.base_sha256) for r in got)
    by_hash = {(str(r.doc_id), hashlib.sha256(written(base(r.text or ""), kinds).encode()).hexdigest()): written(base(r.text or ""), kinds) for r in rows}
    for r in got:  # the method only adds
        mine = set(filter(None, by_hash[str(r.doc_id), r.base_sha256].split(",")))
        assert mine <= set(r.spans.split(",")) and [int(s.split(":")[1]) for s in filter(None, r.spans.split(","))] == sorted(int(s.split(":")[1]) for s in filter(None, r.spans.split(",")))


def test_secrets_base(spark, messy, documents, nothing):
    pieces = ["token", "PASSWORD", "api_key", "apikey", "secret", " ", "=", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "a", "ſ", "é", "-", ".", "paſſword", "x" * 11, "toKen"]
    for docs in (messy, documents, nothing, as_docs(spark, noise(1, pieces)), as_docs(spark, ["token = secret=abcdefghijklmnop", "token=secret:abcdefghijklmn", "x" * 200_000 + "0123456789abcdef0"])):
        check(docs, secrets.digests, base_secrets, secrets.KINDS, 3)


def test_secrets_by_novelty(spark):
    code = "def connect(host, user): auth = "
    texts = [code + "Zk9qW3xTq7LmB2vRt8YcN4pHs6Jd0GfA", code + "connect_to_the_host_and_the_user_1", "plain words only", code + "z" * 30 + "1"]
    got = {r.doc_id: r.spans for r in secrets.digests(as_docs(spark, texts)).collect()}
    assert got[0] == f"novel:{len(code)}:{len(texts[0])}" and got[2] == got[3] == ""


def test_secrets_joined_to_their_names(spark):
    """Values right behind '=' or '_' and values without a digit are measured; NAME=VALUE gives the value's span."""
    value, letters = "Zk9qW3xTq7LmB2vRt8YcN4pHs6Jd0GfA", "ZkPqWHxTqRLmBvVRtUYcNpKHsGJdXGfA"
    names = ["auth=", "pwd=", "credential=", "AWS_SECRET_ACCESS_KEY=", "auth:", "auth = ", "client_auth_"]
    texts = [n + v for n in names for v in (value, letters)] + [f"auth={value}== end", f"auth={value}==x", f"number={value}"]
    want = [f"novel:{len(n)}:{len(n + v)}" for n in names for v in (value, letters)] + [f"novel:5:{7 + len(value)}", f"novel:5:{5 + len(value)}", ""]
    got = {r.doc_id: r.spans for r in secrets.digests(as_docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def novel_by_hand(texts):
    """Spans of the method, one text after another, every step the plain way."""
    identifiers = lambda t: set(re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,31}", t))
    found, around, runs = [], [], set()
    for t in texts:
        words, mine = [m.end() for m in secrets.SENSITIVE.finditer(t)], []
        for m in re.finditer(r"[A-Za-z0-9+/_-]+", t):
            start, end = m.span()
            if end - start < 16:
                continue
            if pad := re.match(r"={1,2}(?![A-Za-z0-9+/_=-])", t[end:]):
                end += len(pad[0])
            if not any(w <= start <= w + 64 for w in words):
                inner = re.search(r"(?i:secret|token|passw|pwd|api|key|auth|bearer|credential|private|signature)[+/_-]+", t[start:end])
                if not inner or end - start - inner.end() < 16:
                    continue
                start += inner.end()
            if not any(a <= start and end <= b for a, _, b in base_secrets(t)):
                mine.append((start, end, t[max(0, start - 200) : start] + t[end : end + 200]))
                runs |= identifiers(m[0])
        found.append(mine)
        if mine:
            around.append(set().union(*(identifiers(x[2]) for x in mine)))
    top = lambda sets: [w for w, _ in sorted(Counter(w for x in sets for w in x).items(), key=lambda x: (-x[1], x[0]))[:2000]][::-1]
    primed = zstandard.ZstdCompressionDict(" ".join(top(identifiers(t) - runs for t in texts) + top(around)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda x: len(zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False).compress(x.encode()))
    return [[(a, b) for a, b, x in mine if size(x + "\n" + t[a:b]) - size(x + "\n") >= 0.6 * (b - a)] for t, mine in zip(texts, found, strict=True)]


def test_novelty_against_plain_python(spark, documents):
    """Planted keys among documents and code: the same spans as the plain way, all planted ones and none in documents."""
    r = random.Random(8)
    key = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789+/") for _ in range(n))
    code = "def connect(host, user, retries):\n    client = make_client(host)\n    return client.retry(user, retries)\n"
    planted = [(code + f"signature = '{key(n)}'\n" + code, n) for n in (16, 20, 32, 40, 64, 200, 3000)]
    plain = [code + "auth = make_client_connect_retry_host_user\n", code + "bearer: connect-host-user-retries-client\n", "private " + "ab" * 40]
    texts = [x.text or "" for x in documents.collect()] + [t for t, _ in planted] + plain + noise(4, ["key", "=", " ", key(20), "connect_client_retry", "a", "_", "-", "é", ":"], 100)
    n = len(texts) - len(planted) - len(plain) - 100
    want = novel_by_hand(texts)
    got = {x.doc_id: [tuple(map(int, s.split(":")[1:])) for s in x.spans.split(",") if s.startswith("novel")] for x in secrets.digests(as_docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert not any(want[:n]) and [b - a for x in want[n : n + len(planted)] for a, b in x] == [k for _, k in planted]
    assert not any(want[n + len(planted) : n + len(planted) + len(plain)])


def test_secrets_of_any_length(spark):
    """A long key is measured and reported whole, however far its end is from the word."""
    r = random.Random(3)
    keys = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)) for n in (513, 1600, 100_000)]
    got = {x.doc_id: x.spans for x in secrets.digests(as_docs(spark, [f"private_key: {k} end" for k in keys])).collect()}
    assert [got[i] for i in range(3)] == [f"novel:13:{13 + len(k)}" for k in keys]


def test_pii_base(spark, messy, documents, nothing):
    pieces = ["a", "b_c", "@", ".", "-", "+", "%", "1", "255", "256", "00010", " ", "(", "4111 1111 1111 1111", "+49 30 1234567", "x.y@z.de", "_d@e.f", "é", "日", "1.2.3.4", "@@", "…"]
    long = ["1 " * 20_000, "9" * 30_000, "a" * 50_000 + "@b.c", "a.b" * 5_000 + "@" + "c.d" * 5_000, "1.2.3.4.5.6.7.8", "999999999999999999999.1.1.1", "+1 (2) 3"]
    for docs in (messy, documents, nothing, as_docs(spark, noise(2, pieces)), as_docs(spark, long)):
        check(docs, pii.digests, base_pii, pii.KINDS, 4)


def test_sensitive_terms(spark):
    """A name that comes only with one address is found and removed; a common word near it isn't."""
    texts = [f"note{i} Zorblat said this to {w} mail zor@x.org of report{i}" for i, w in enumerate(["ann", "bob", "cid", "dan"])]
    texts += ["later zorblat came back alone"] + [f"she said this and that number {i}" for i in range(40)]
    docs = as_docs(spark, [*texts, texts[0], None]).withColumn("near", F.lit(1))
    got = {r.doc_id: r for r in pii.digests(docs).collect()}
    at = texts[4].index("zorblat")
    assert got[4].spans == f"term:{at}:{at + 7}" and got[0].n_term and got[0].n_email == 1
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[4] == "later  came back alone" and clean[10] == texts[10] and clean[len(texts) + 1] is None
    assert "[EMAIL]" in clean[0] and "zor" not in clean[0].lower() and "said" in clean[0]


def test_parts_of_an_address_name(spark):
    """A name that an address holds is found, in its text and in another; words beside it in one text aren't, nor does a copy add weight."""
    common = " ".join(f"word{i}" for i in range(60))
    texts = [f"Quendrix Zorblat {common} quendrix.77@y.org", f"then quendrix {common} zorblat", *(f"{common} {i} then" for i in range(600))]
    got = {r.doc_id: r.spans for r in pii.digests(as_docs(spark, texts + [texts[1]] * 50)).collect()}
    assert got[0].split(",")[0] == "term:0:8" and got[1] == got[601 + 50] == "term:5:13"
    assert all(got[i] == "" for i in range(2, 602)) and got[0].count("term:") == 2  # the other within the address


def test_copies_and_forms_disclose_nothing(spark):
    """What many texts with an entity share word by word is a form; a name beside the same address in texts of their own is a name."""
    form = " ".join(f"clause{i}" for i in range(40))
    texts = [f"{form} form{i} help@desk.org" for i in range(6)] + [f"own{i} mine{i} Zorblat writes{i} zor1@x.org" for i in range(6)] + [f"filler{i} text{i} of{i} it" for i in range(400)]
    got = {r.doc_id: r.spans for r in pii.digests(as_docs(spark, texts)).collect()}
    assert not any("term" in got[i] for i in range(6)) and all(got[i].count("term:") == 1 for i in range(6, 12)) and not any(got[i] for i in range(12, len(texts)))


def test_no_term_is_dropped_for_its_company(spark):
    """An entity that twelve terms disclose has them all where no company bounds them, and none by default."""
    own = " ".join(f"clue{chr(97 + k)}" for k in range(12))
    docs = as_docs(spark, [f"{own} mine{i} help@desk.org" for i in range(6)] + [f"filler{i} text{i}" for i in range(400)])
    scan = pii.scanned(docs).cache()
    assert {r.term for r in pii.sensitive_terms(docs, scan, company=None).collect()} == set(own.split())
    assert pii.sensitive_terms(docs, scan).isEmpty()


def sensitive_by_hand(texts, spans):
    """The measure, pair by pair."""
    distinct = {t: s for t, s in zip(texts, spans, strict=True)}
    terms, entities, parts = {}, {}, {}
    for t, own in distinct.items():
        out, upto = [], 0
        for start, _, end in sorted(own):
            if start >= upto:
                out += [t[upto:start], " "]
            upto = max(upto, end)
        words = lambda x: {w.lower() for w in regex.findall(r"[\p{L}\p{N}_]+", x)}
        terms[t] = words("".join([*out, t[upto:]]) if own else t)
        names, local = set(), set()
        for start, kind, end in own:
            v = t[start:end]
            names.add((kind, v.lower() if kind == 0 else v if kind == 1 else re.sub("[^0-9]", "", v)))
            if kind == 0:
                local |= set(regex.findall(r"\p{L}{3,}", v.rsplit("@", 1)[0].lower()))
        entities[t], parts[t] = names, local
    total = len(distinct)
    # terms of the whole text count for its frequency
    whole_terms = {t: {w.lower() for w in regex.findall(r"[\p{L}\p{N}_]+", t)} for t in distinct}
    df = Counter(w for x in whole_terms.values() for w in x)
    sets = {}
    for t, names in entities.items():
        for e in names:
            sets.setdefault(e, set()).add(t)
    classes = {frozenset(x) for x in sets.values() if len(x) < total}
    pairs = {}
    for c in classes:
        both = Counter(w for t in c for w in terms[t])
        for w, k in both.items():
            if df[w] <= max(2 * len(c), 2):
                pairs[c, w] = (k, any(w in terms[t] and w in parts[t] for t in c))
    strong, found = {}, set()
    for (c, w), (k, tied) in pairs.items():
        n, z, f = df[w], pii.DEVIATIONS, len(c) / total
        p = k / n
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        kl = p * math.log(p / f) + ((1 - p) * math.log((1 - p) / (1 - f)) if k < n else 0)
        if k >= 2 and low >= 0.5 and p > f and n * kl >= math.log(len(pairs) / pii.ERROR):
            strong.setdefault(c, set()).add(w)
        if tied and 2 * k >= n:
            found.add(w)
    return found.union(*(x for x in strong.values() if len(x) <= pii.COMPANY))


def test_sensitive_terms_by_hand(spark, messy, documents, nothing):
    """On documents with planted names, on messy rows and on none: the terms of the plain way."""
    r = random.Random(5)
    planted = [f"{r.choice(['ask', 'call', 'tell'])} Zorblat{i % 7} about {r.randrange(9**9)} by zor.{i % 7}@x{i % 7}.org or quen{i % 5}@y.org" for i in range(40)] + [f"zorblat{i} alone {i}" for i in range(7)]
    for docs in (messy, nothing, as_docs(spark, [x.text or "" for x in documents.collect()] + planted + planted[:5])):
        scan = pii.scanned(docs).cache()
        spans = {x.id if x.id is not None else -1: [(s["start"], s["kind"], s["end"]) for s in x.spans] for x in scan.collect()}
        rows = docs.collect()
        got = {x.term for x in pii.sensitive_terms(docs, scan).collect()}
        want = sensitive_by_hand([x.text or "" for x in rows], [spans[x.doc_id if x.doc_id is not None else -1] for x in rows]) if rows else set()
        assert got == want
    assert {f"zorblat{i}" for i in range(7)} <= got


def test_names_are_found_and_clean_documents_left_alone(spark):
    """Names planted beside addresses in documents: nine of ten and more are found where they stand alone; of documents without an entity or a name, one in a hundred at most is marked."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = [x.text or "" for x in docs]
    r = random.Random(6)
    names = [f"{r.choice(['Ba', 'Zor', 'Quen', 'Mi'])}{r.choice(['blat', 'drix', 'kov', 'tan'])}{r.choice(['ski', 'er', 'ov', 'by'])}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    clean = [i for i, t in enumerate(texts) if "@" not in t and not any(c.isdigit() for c in t) and len(t) > 400]
    r.shuffle(clean)
    alone = {}
    for k, name in enumerate(names):
        for i in clean[k * 6 : k * 6 + 4]:
            texts[i] = f"{texts[i][:200]} {name} c{k}@mail{k % 3}.example.com {texts[i][200:]}"
        alone[clean[k * 6 + 4]] = name
        texts[clean[k * 6 + 4]] += f" {name}"
    got = {x.doc_id: x for x in pii.digests(as_docs(spark, texts)).collect()}
    hits = sum(f"term:{texts[i].index(name)}:{texts[i].index(name) + len(name)}" in got[i].spans for i, name in alone.items())
    assert hits >= 0.9 * len(names)
    others = [x for i, x in got.items() if i not in alone and not (x.n_email or x.n_ip or x.n_card or x.n_phone)]
    assert sum(x.n_term > 0 for x in others) <= 0.01 * len(others)


def test_other_words_pass_the_filter_alike_at_any_size(spark):
    """Of words that are no sensitive terms, about one in SPARE ** 2 passes, whether there are few or many terms; all terms pass."""
    for n in (2_000, 200_000):
        terms = spark.range(n).select(F.concat(F.lit("term"), "id").alias("term")).cache()
        rows = spark.range(200_000).select(F.concat(F.lit("word"), "id").alias("term"))
        assert pii._sharing(terms, terms, "term").count() == n
        assert 0.5 < pii._sharing(rows, terms, "term").count() * pii.SPARE**2 / 200_000 < 1.5


def test_redacted_union_of_overlaps(spark):
    spans = [(0, 2, 4, "abcd"), (2, 3, 6, "cdef"), (8, 4, 9, "i")]
    df = spark.createDataFrame([("abcdefghij", spans)], "text string, spans array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    assert df.select(pii.redacted(F.col("text"), F.col("spans"))).first()[0] == "[CARD]ghj"
