"""Secret scan: fixed patterns, and strings in sensitive context that zstandard finds no precedent for.

One scan of the texts keeps, per document, the spans of the patterns and the
candidates: maximal runs of token characters, '=' and ':' ending a run, that
follow a sensitive word closely or, after a joining mark, in the same run, and
are not wholly inside a pattern's span. A zstandard dictionary is primed with the
DICTIONARY_WORDS identifiers that stand in most documents of the whole corpus and
with as many that stand around most candidates. A candidate's marginal bytes are
those that it adds to its compressed surroundings, AROUND code points on each
side, under that dictionary; if they are at least NOVELTY of its length, it is
reported. Only the two lists of top words reach the driver.

Defined results: null counts as empty; an empty text has no spans; texts are
scanned whole, however long; repeated rows each give a row; null ids stay null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.text import whole
from pointloom.scratch import stored

KINDS = ("assign", "access", "hex", "novel")
#: The patterns of the contract, and what follows a match of each to keep it.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of 16 and more are the runs of any length that have 16
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 12, "access": 18}

#: Words that make what follows sensitive.
SENSITIVE = re.compile(r"secret|token|passw|pwd|api|key|auth|bearer|credential|private|signature", re.I | re.A)
LEAST_RUN = 16
#: A run of token characters that nothing but '=' or ':' cuts; '=' at its very end is padding and belongs to it.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
JOINED = re.compile(rf"(?:{SENSITIVE.pattern})[+/_-]+", re.I | re.A)
REACH = 64  # code points from the sensitive word to a candidate
AROUND = 200  # code points of surroundings on each side
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{2,31}"
DICTIONARY_WORDS = 2000  # of the corpus, and of the surroundings of candidates
NOVELTY = 0.6
LEVEL = 19

_SCANNED = "id {id}, n_assign bigint, n_access bigint, n_hex bigint, base array<string>, candidates array<struct<start:bigint,end:bigint,string:string,run:string,around:string>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Token runs in sensitive context that are not wholly inside a base span, with their surroundings."""
    words = [m.end() for m in SENSITIVE.finditer(text)]
    starts, furthest = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    out = []
    for m in CANDIDATE.finditer(text) if words else ():
        start, end = m.span()
        before = bisect_right(words, start)
        if not before or start > words[before - 1] + REACH:
            # the word may be in the run itself, with a mark between it and the rest
            joined = JOINED.search(text, start, end)
            if not joined or end - joined.end() < LEAST_RUN:
                continue
            start = joined.end()
        inside = bisect_right(starts, start)
        if not inside or furthest[inside - 1] < end:
            out.append({"start": start, "end": end, "string": text[start:end], "run": m[0], "around": text[max(0, start - AROUND) : start] + text[end : end + AROUND]})
    return out


def scanned(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts and spans of the patterns, and candidates."""
    rows = docs.select(F.col(id_col).alias("id"), whole(text).alias("text"))
    schema = _SCANNED.format(id=rows.schema["id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            kind = kind or pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("string", pa.string()), ("run", pa.string()), ("around", pa.string())]))
            counts, base, more = ([], [], []), [], []
            for value in batch.column("text"):
                t = value.as_py()
                spans = base_spans(t)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in spans))
                base.append([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])
                more.append(candidates(t, spans))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.list_(pa.string())), pa.array(more, kind)], ["id", "n_assign", "n_access", "n_hex", "base", "candidates"])

    return rows.mapInArrow(run, schema)


def identifier_dictionary(docs: DataFrame, scan: DataFrame, text: str = "text", words: int = DICTIONARY_WORDS) -> bytes:
    """The identifiers of most documents, but for those of candidates, which would vouch for themselves, then those around most candidates; at most `words` of 32 characters each, the most frequent last, where matches cost least."""
    found = lambda c: F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0))
    of = lambda part: F.array_distinct(F.flatten(F.transform("candidates", lambda c: found(c[part]))))
    some = scan.where(F.size("candidates") > 0)
    words_of = lambda rows, w, own: rows.select(F.explode(w).alias("w"), F.lit(own).alias("own"))
    corpus = words_of(docs, F.array_distinct(found(whole(text))), False).unionByName(words_of(some, of("run"), True))
    both = (corpus, words_of(some, of("around"), False))
    # combined in tasks before the shuffle; a join with the candidates' own words would come before that
    counts = [rows.groupBy("w").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("NOT own") for rows in both]
    tops = [c.orderBy(F.desc("n"), "w").limit(words).collect() for c in counts]
    return " ".join(r["w"] for top in tops for r in reversed(top)).encode()


class Novelty:
    """Marginal compressed bytes of a string against its surroundings and a dictionary."""

    def __init__(self, dictionary: bytes):
        import zstandard

        args = {"level": LEVEL, "write_checksum": False, "write_content_size": False}
        if len(dictionary) >= 8:
            primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=LEVEL)
            args["dict_data"] = primed
        self.compressor = zstandard.ZstdCompressor(**args)

    def marginal(self, string: str, around: str) -> int:
        base = around.encode()
        return len(self.compressor.compress(base + b"\n" + string.encode())) - len(self.compressor.compress(base + b"\n"))

    def reported(self, string: str, around: str) -> bool:
        return self.marginal(string, around) >= NOVELTY * len(string)


def secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_novel, base array<string>, spans array<string>): spans as kind:start:end in code points, by start, then kind."""
    scan = stored(scanned(docs, text, id_col), "secrets")
    dictionary = identifier_dictionary(docs, scan, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty(dictionary)
        for batch in batches:
            spans, counts = [], []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                novel = [f"novel:{c['start']}:{c['end']}" for c in more if measure.reported(c["string"], c["around"])]
                counts.append(len(novel))
                spans.append(sorted(base + novel, key=lambda s: (int(s.split(":")[1]), KINDS.index(s.split(":")[0]))) if novel else base)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_assign", "n_access", "n_hex")), pa.array(counts, pa.int64()), batch.column("base"), pa.array(spans, pa.list_(pa.string()))], ["id", "n_assign", "n_access", "n_hex", "n_novel", "base", "spans"])

    kind = scan.schema["id"].dataType.simpleString()
    return scan.mapInArrow(run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base array<string>, spans array<string>").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    df = secrets(docs, text, id_col)
    return df.select(id_col, "n_assign", "n_access", "n_hex", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"), "n_novel")
