"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

Everything is a column expression or a join. Entities (addresses and numbers)
and terms are counted over whole distinct texts, so copies of one text count
once; a text has the terms that stand outside its entities. A term's share of an
entity is the part of the term's texts that have it, at the lower end of its Wilson
interval of `deviations` standard deviations. A term that gives away an entity's
information, log2(texts / texts with the entity), but for LEFT_BITS or less, that is,
whose share is at least 2 ** -LEFT_BITS, discloses it, if

- it stands beside the entity in TEXTS or more texts, and so more often than chance
  allows: with f the entity's part of all texts and p that of the term's texts, the
  bound exp(-n KL(p, f)) on the chance of as many among its n texts is at most ERROR
  after division by the number of pairs tested; and
- the entity has at most COMPANY such terms. Texts that share more are copies or
  fillings of one form. With company=None this rule is left out: every term counts,
  of every entity.

A term that is a part of an address's name (zor of zor@x.org) discloses it from one
text on, if at least half of its texts have the address. None of these bounds loosens
as the corpus grows. Terms that disclose an entity are sensitive wherever they stand:
they become spans, and sanitised() generalises entities to their kind and removes the
terms.

Entities that stand in the same texts disclose alike and are counted as one
(entity_classes). Document frequencies are counted over the whole corpus, combined
in each task before they are shuffled. The words of other texts meet sensitive terms
by a join; if those are MOST_NUMBERS or fewer, words are first held against broadcast
hashes of them, in a table of SPARE places for each, so that the part of other words
that passes is about 1 / SPARE ** 2 at any size.

Defined results: null counts as empty; an empty text has no spans; matches that
fail a check are dropped without retries; texts, entities and terms of any
length are read whole, in time in proportion to the text; overlapping spans of
different kinds all count and sanitised() replaces their union by the first
one's mark; repeated rows each give a row; null ids stay null; an empty table
gives an empty result; other columns are kept by sanitised() and not read
elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.text import whole
from pointloom.scratch import fresh, stored

KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns of the contract, written so that matching takes time in proportion to the text. \G is the end of the match before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_HINT = r"[0-9](?:[\x20-]?[0-9]){11}"
IP_HINT = r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"
OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

TERM = r"[\p{L}\p{N}_]+"
PART = r"\p{L}{3,}"  # of an address's name
DEVIATIONS = 1.0
LEFT_BITS = 1.0
TEXTS = 2
ERROR = 0.05
COMPANY = 8
SPARE = 16
MOST_NUMBERS = 1 << 21  # that are broadcast at once
BLOCK = 64  # elements that running() adds up in one go


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being made once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array, plus() over all before it, 0 for the first. Totals of blocks first, so that no long array grows by one element at a time."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def scan(items: Column, start: Column, total: Callable[[Column], Column]) -> Column:
        step = lambda acc, x: F.struct(plus(acc["at"], total(x)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(items, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        bases = scan(blocks, zero, lambda block: F.aggregate(block, zero, plus))
        return let(bases, lambda base: F.flatten(F.transform(blocks, lambda block, k: scan(block, F.get(base, k), lambda x: x))))

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / BLOCK).cast("int") - 1, F.lit(0))), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))

    return let(values, lambda v: let(cut(v), of_blocks))


def _placed(text: Column, pattern: str, span: Callable[[Column, Column, Column], Column]) -> Column:
    """span(start, end, value) of each leftmost non-overlapping match: places add up from the pieces between matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"))
    sizes = lambda p: F.transform(p, lambda x: (F.char_length(x["gap"]) + F.coalesce(F.char_length(x["value"]), F.lit(0))).cast("long"))

    def spans(p: Column) -> Column:
        def one(x: Column) -> Column:
            start = x["p"]["gap"]
            return let(x["before"] + F.char_length(start).cast("long"), lambda at: span(at, at + F.char_length(x["p"]["value"]).cast("long"), x["p"]["value"]))

        zipped = F.arrays_zip(p.alias("p"), running(sizes(p), lambda x, y: x + y).alias("before"))
        return F.transform(F.filter(zipped, lambda x: x["p"]["value"].isNotNull()), one)

    return let(pairs, spans)


def located(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end, value>>."""
    return _placed(text, pattern, lambda start, end, value: F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether digits pass the check: every second from the right doubled, less 9 above 9, in a sum divisible by 10."""
    n = F.char_length(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(value, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: int) -> Callable[[Column], Column]:
    def ip(s: Column) -> Column:
        return F.forall(F.split(s["value"], r"\."), lambda part: part.rlike(OCTET))

    def card(s: Column) -> Column:
        d = digits(s["value"])
        return F.when(F.char_length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))

    def phone(s: Column) -> Column:
        return F.char_length(digits(s["value"])).between(9, 15)

    return {1: ip, 2: card, 3: phone}[kind]


def entity_spans(text: Column) -> list[Column]:
    """Spans of each kind; texts without a hint of a kind are not searched for it."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    return [
        F.when(F.contains(text, F.lit("@")), located(text, EMAIL, 0)).otherwise(none),
        F.when(text.rlike(IP_HINT), F.filter(located(text, IP, 1), _valid(1))).otherwise(none),
        F.when(text.rlike(CARD_HINT), F.filter(located(text, CARD, 2), _valid(2))).otherwise(none),
        F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE, 3), _valid(3))).otherwise(none),
    ]


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda x: F.lower(x)))


def _key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text))


def spans_of(rows: DataFrame) -> DataFrame:
    """rows with the entity spans of their column text by start, then kind."""
    keep = rows.columns
    kinds = rows.select(*keep, *[c.alias(k) for c, k in zip(entity_spans(F.col("text")), KINDS, strict=False)])
    return kinds.select(*keep, F.array_sort(F.concat(*KINDS[:4])).alias("spans"))


def scanned(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, key, spans, terms): spans by start, then kind; terms are those outside of the spans, null where there is no span."""
    spans = spans_of(docs.select(F.col(id_col).alias("id"), whole(text).alias("text")))
    return spans.select("id", _key(F.col("text")).alias("key"), "spans", F.when(F.size("spans") > 0, _terms(redacted(F.col("text"), F.col("spans"), [" "] * 5))).alias("terms"))


def entity_classes(named: DataFrame, n_texts: int) -> DataFrame:
    """(key, class, bits) from distinct texts (key, spans): the classes of entities that stand in the same texts, for each of their texts; class.n is how many, bits the information of such an entity."""
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.when(s["kind"] == 0, F.lower(s["value"])).when(s["kind"] == 1, s["value"]).otherwise(digits(s["value"])))
    with_entity = stored(named.select("key", F.explode(F.array_distinct(F.transform("spans", name))).alias("entity")), "entities")
    # a set of texts is known by its size and two sums of hashes of its texts
    per = with_entity.groupBy("entity").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"))
    per = stored(per.where(F.col("n") < n_texts), "entity_counts")
    return with_entity.join(per, "entity").select("key", F.struct("n", "x", "y").alias("class"), F.log2(F.lit(n_texts) / F.col("n")).alias("bits")).distinct()


def _sharing(rows: DataFrame, other: DataFrame, column: str, spare: int = SPARE) -> DataFrame:
    """Rows whose column may equal one of other's, a written table without repeated values: all that do, and about 1 in spare ** 2 of those that don't. Hashes of other are broadcast twice, MOST_NUMBERS of them at most; beyond that all rows pass."""
    n = other.count()
    if n > MOST_NUMBERS:
        return rows
    for k in range(2):
        bucket = F.pmod(F.xxhash64(F.lit(k), F.col(column)), F.lit(max(1024, spare * n))).alias("bucket")
        rows = rows.join(F.broadcast(other.select(bucket).distinct()), bucket == F.col("bucket"), "left_semi")
    return rows


def least_share(hits: Column, n: Column, z: float = DEVIATIONS) -> Column:
    """The lower end of the Wilson interval of z standard deviations for hits of n."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def beyond_chance(both: Column, n: Column, part: Column, tests: Column) -> Column:
    """Whether `both` of n texts are too many for an entity in that part of all texts, `tests` such questions being asked: n KL(both / n, part) against log(tests / ERROR)."""
    p = both / n
    other = F.when(both < n, (1 - p) * F.log((1 - p) / (1 - part))).otherwise(F.lit(0.0))
    return (p > part) & (n * (p * F.log(p / part) + other) >= F.log(tests / ERROR))


def sensitive_terms(docs: DataFrame, scan: DataFrame, text: str = "text", deviations: float = DEVIATIONS, company: int | None = COMPANY) -> DataFrame:
    """(term, disclosure): terms that reveal some entity, from docs and what scanned() has of them; disclosure is the largest part of an entity's information that a term gives away. Without a company, all terms of every entity."""
    n_texts = scan.select("key").distinct().count()
    named = stored(scan.where(F.size("spans") > 0).dropDuplicates(["key"]), "named")
    classes = stored(entity_classes(named, n_texts), "classes")
    addresses = F.filter("spans", lambda s: s["kind"] == 0)
    parts = F.flatten(F.transform(addresses, lambda s: F.regexp_extract_all(F.lower(F.substring_index(s["value"], "@", 1)), F.lit(PART), F.lit(0))))
    with_term = named.select("key", parts.alias("parts"), F.explode("terms").alias("term"))
    with_term = stored(with_term.select("key", "term", F.array_contains("parts", F.col("term")).alias("tied")), "named_terms")
    # numbered, so that tasks keep one copy of a text each before the shuffle
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    texts = docs.select(_key(whole(text)).alias("key"), whole(text).alias("text")).withColumn("nth", nth).where(F.col("nth") == 1)
    counts = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("term_texts"))
    per_term = stored(counts.join(with_term.select("term").distinct(), "term", "left_semi"), "term_counts")
    rare = with_term.join(per_term, "term")
    # a term of more than twice the entity's texts has a share below a half, whichever they are
    room = F.col("class.n") * F.ceil(F.pow(F.lit(2.0), F.lit(LEFT_BITS)))
    pairs = rare.join(classes, "key").where(F.col("term_texts") <= F.greatest(room, F.lit(2)))
    pairs = stored(pairs.groupBy("class", "term", "bits", "term_texts").agg(F.count("*").alias("both"), F.max("tied").alias("tied")), "pairs")
    tests = F.lit(max(1, pairs.count()))
    share = least_share(F.col("both"), F.col("term_texts"), deviations)
    told = pairs.withColumn("disclosure", F.greatest(F.lit(0.0), 1 + F.log2(share) / F.col("bits")))
    often = (F.col("both") >= TEXTS) & (share >= F.pow(F.lit(2.0), F.lit(-LEFT_BITS))) & beyond_chance(F.col("both"), F.col("term_texts"), F.col("class.n") / n_texts, tests)
    strong = stored(told.where(often), "strong")
    few = strong if company is None else strong.join(strong.groupBy("class").agg(F.count("*").alias("company")).where(F.col("company") <= company), "class")
    tied = told.where(F.col("tied") & (2 * F.col("both") >= F.col("term_texts")))
    found = few.select("term", "disclosure").unionByName(tied.select("term", "disclosure"))
    return found.groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def term_spans(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(key, more): the places of sensitive terms in each distinct text that holds one. Texts that hold none are read, but places are made for the others only."""
    rows = docs.select(_key(whole(text)).alias("key"), whole(text).alias("text"))
    held = _sharing(rows.select("key", F.explode(_terms(F.col("text"))).alias("term")), terms, "term").join(terms.select("term"), "term")
    held = stored(held.select("key").distinct(), "held")
    all_places = _placed(F.col("text"), TERM, lambda start, end, value: F.struct(F.lower(value).alias("term"), start.alias("start"), end.alias("end"), value.alias("value")))
    at = _sharing(_sharing(rows, held, "key").select("key", F.explode(all_places).alias("at")).select("key", "at.*"), terms, "term")
    at = at.join(terms.select("term"), "term").select("key", "start", "end", "value").distinct()
    return at.groupBy("key").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "value")).alias("more"))


def found(docs: DataFrame, text: str = "text", id_col: str = "doc_id", deviations: float = DEVIATIONS, company: int | None = COMPANY) -> DataFrame:
    """(id, key, spans): all spans of each row by start, then kind."""
    scan = stored(scanned(docs, text, id_col), "entities")
    terms = stored(sensitive_terms(docs, scan, text, deviations, company), "terms")
    placed = stored(term_spans(docs, terms, text), "term_spans")
    none = F.array().cast(placed.schema["more"].dataType)
    out = scan.join(placed, "key", "left").select(F.col("id").alias(id_col), "key", F.array_sort(F.concat("spans", F.coalesce("more", none))).alias("spans"))
    return out


def _written(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", deviations: float = DEVIATIONS, company: int | None = COMPANY) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans)."""
    df = found(docs, text, id_col, deviations, company)

    def of_kind(k: int) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == k  # of one argument: Spark would pass the index as a second

    count = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return df.select(id_col, *count, F.sha2(_written(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, marks: Sequence[str] = (*(f"[{k.upper()}]" for k in KINDS[:4]), "")) -> Column:
    """The text with each entity generalised to its kind in brackets and each sensitive term removed, or with other marks by kind; spans come by start."""
    mark = F.array(*map(F.lit, marks))

    def pieces(chars: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        part = lambda first, n: F.array_join(F.slice(chars, (first + 1).cast("int"), n.cast("int")), "")
        covered = F.arrays_zip(spans.alias("s"), running(ends, lambda x, y: F.greatest(x, y)).alias("upto"))
        # a span that begins inside another adds to its union and has no mark
        first = F.filter(covered, lambda x: x["s"]["start"] >= x["upto"])
        said = F.transform(first, lambda x: F.concat(part(x["upto"], x["s"]["start"] - x["upto"]), F.element_at(mark, x["s"]["kind"] + 1)))
        return F.concat(F.array_join(said, ""), let(F.coalesce(F.array_max(ends), F.lit(0).cast("long")), lambda last: part(last, F.size(chars))))

    return let(F.split(text, ""), pieces)


def sanitised(docs: DataFrame, text: str = "text", id_col: str = "doc_id", deviations: float = DEVIATIONS) -> DataFrame:
    """docs with its texts redacted; rows without spans, null texts among them, as they were."""
    k, s = (fresh(docs.columns, f"__{x}") for x in ("key", "spans"))
    spans = stored(found(docs, text, id_col, deviations).where(F.size("spans") > 0).select(F.col("key").alias(k), F.col("spans").alias(s)).dropDuplicates([k]), "spans")
    df = docs.join(spans, _key(whole(docs[text])) == F.col(k), "left")
    new = F.when(F.col(s).isNotNull(), redacted(whole(docs[text]), F.col(s))).otherwise(docs[text])
    return df.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
