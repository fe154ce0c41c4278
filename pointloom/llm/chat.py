"""Preference formatting: one rendered prompt and two masked completions for each pair of conversations.

The prompt is the longest common turn prefix of the chosen and the rejected
conversation, rendered once; what follows it on each side is a completion. The
result has one row per rendered turn, so a conversation of any length spreads
over tasks: no turn list is gathered. assembled() folds those rows into strings.

A turn that both sides have comes once, with a flag for each side (of_sides()
makes such rows of one row per side). Places and code points of both sides are
running sums over the same rows, so texts are shuffled once: what the prefix of
a pair is comes back to its rows by the key by which they are already dealt.

Defined results: turns of a side stand in order of (turn, role, text), nulls
first, repeated rows one after another; turns are common if role and text agree,
null agreeing with null; a null role is rendered as NO_ROLE and a null text as
empty; a turn of any length is rendered whole; a pair with one side has an empty
prompt and that side's completion; two equal sides give a prompt and empty
completions; rows with a null pair or on no side are left out; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("chosen", "rejected")
HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"
NO_ROLE = "none"
TRAINED = "assistant"
BUCKET_TURNS = 64
ROW_CHARS = 1 << 24  # of a pair in one row


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(role, F.lit(NO_ROLE)), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(TAIL))


def of_sides(rows: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected, turn, role, text), the sides as flags, from rows of (pair_id, side, turn, role, text)."""
    flags = [F.coalesce(F.col("side") == s, F.lit(False)).alias(s) for s in SIDES]
    return rows.select("pair_id", *flags, "turn", "role", "text")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds bucket, length and, for each side, its turns (at_) and code points (from_) before the row in order of (turn, role, text). A bucket holds BUCKET_TURNS turn numbers; only totals of buckets are added up per pair."""
    first = F.lit(-(1 << 62)).cast("long")
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / BUCKET_TURNS).cast("long"), first)).withColumn("length", F.char_length(rendered(F.col("role"), F.col("text"))).cast("long"))
    one = lambda s: F.when(F.col(s), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    counts = {**{f"at_{s}": one(s) for s in SIDES}, **{f"from_{s}": one(s) * F.col("length") for s in SIDES}}
    totals = rows.groupBy("pair_id", "bucket").agg(*[F.sum(c).alias(k) for k, c in counts.items()])
    upto = Window.partitionBy("pair_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.select("pair_id", "bucket", *[(F.sum(k).over(upto) - F.col(k)).alias(f"base_{k}") for k in counts])
    within = Window.partitionBy("pair_id", "bucket").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(totals, ["pair_id", "bucket"])
    return rows.select(*[c for c in rows.columns if not c.startswith("base_")], *[(F.col(f"base_{k}") + F.sum(c).over(within) - c).alias(k) for k, c in counts.items()])


def prefixes(rows: DataFrame) -> DataFrame:
    """(pair_id, bucket, n_prompt, prompt_length) from numbered(), for each bucket of a pair.

    The prompt ends at the first place where the sides differ. A row of both sides
    at the same place is common; other rows meet by place, as digests.
    """
    digest = F.md5(F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}))
    side = lambda s: F.when(F.col(s), F.struct(F.lit(s).alias("side"), F.col(f"at_{s}").alias("place"), F.col(f"from_{s}").alias("begin")))
    common = F.col("chosen") & F.col("rejected") & (F.col("at_chosen") == F.col("at_rejected"))
    rest = rows.where(~common).select("pair_id", digest.alias("digest"), F.explode(F.array_compact(F.array(*map(side, SIDES)))).alias("s")).select("pair_id", "digest", "s.*")
    places = rest.groupBy("pair_id", "place").agg(F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"), F.min("begin").alias("begin"))
    ends = places.where("n < 2 OR a <> b").groupBy("pair_id").agg(F.min(F.struct("place", "begin")).alias("end"))
    buckets = rows.groupBy("pair_id", "bucket").agg(F.sum(F.when(F.col("chosen"), 1).otherwise(0)).alias("turns"))
    # without a place where they differ, the whole conversation is prompt
    turns = buckets.groupBy("pair_id").agg(F.sum("turns").alias("turns"))
    per = turns.join(ends, "pair_id", "left").select("pair_id", F.coalesce("end.place", "turns").alias("n_prompt"), F.coalesce("end.begin", F.lit(0)).alias("prompt_length"))
    return buckets.select("pair_id", "bucket").join(per, "pair_id")


def segments(pairs: DataFrame) -> DataFrame:
    """(pair_id, part, place, role, rendered, start, end, trained, n_prompt) from rows of (pair_id, chosen, rejected, turn, role, text).

    part is prompt, chosen or rejected; start and end are code points in the part;
    trained marks what the loss covers: completions' turns of the assistant.
    """
    rows = numbered(pairs.select("pair_id", *[F.coalesce(s, F.lit(False)).alias(s) for s in SIDES], "turn", "role", "text").where("pair_id IS NOT NULL AND (chosen OR rejected)"))
    rows = rows.join(prefixes(rows).hint("merge"), ["pair_id", "bucket"])
    n, skipped = F.col("n_prompt"), F.col("prompt_length")
    part = lambda name, s, when, begin: F.when(F.col(s) & when, F.struct(F.lit(name).alias("part"), F.col(f"at_{s}").alias("place"), begin.alias("start")))
    parts = [part("prompt", "chosen", F.col("at_chosen") < n, F.col("from_chosen")), *[part(s, s, F.col(f"at_{s}") >= n, F.col(f"from_{s}") - skipped) for s in SIDES]]
    placed = rows.select("*", F.explode(F.array_compact(F.array(*parts))).alias("p"))
    trained = (F.col("p.part") != "prompt") & (F.coalesce("role", F.lit("")) == TRAINED)
    return placed.select("pair_id", "p.part", "p.place", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), "p.start", (F.col("p.start") + F.col("length")).alias("end"), trained.alias("trained"), "n_prompt")


def assembled(rows: DataFrame, most: int = ROW_CHARS) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask) from segments(): one row a pair; masks are spans that the loss covers. Pairs of more than `most` code points don't become rows; segments() has them turn by turn."""
    sizes = rows.groupBy("pair_id").agg(F.sum(F.col("end") - F.col("start")).alias("size")).where(F.col("size") <= most)
    turn = F.struct("place", "rendered", "start", "end", "trained")
    per = rows.join(sizes.select("pair_id"), "pair_id").groupBy("pair_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == p, turn))).alias(p) for p in ("prompt", *SIDES)])
    said = [F.array_join(F.transform(p, lambda x: x["rendered"]), "").alias(p) for p in ("prompt", *SIDES)]
    mask = [F.transform(F.filter(p, lambda x: x["trained"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(f"{p}_mask") for p in SIDES]
    return per.select("pair_id", *said, *mask)


def pairs_of_neighbours(conversations: DataFrame) -> DataFrame:
    """Preference rows from plain conversations (conv_id, turn, role, text): chosen is a conversation as it is; rejected has its turns under a cut of 1 to 4, by its id, and from there on those of the conversation whose id differs in the lowest bit."""
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    other = F.col("conv_id").bitwiseXOR(F.lit(1).cast("long"))
    before = lambda pair: F.coalesce(F.col("turn") < 1 + F.pmod(pair, F.lit(4)), F.lit(True))
    own = F.struct(F.col("conv_id").alias("pair_id"), F.lit(True).alias("chosen"), before(F.col("conv_id")).alias("rejected"))
    lent = F.when(~before(other), F.struct(other.alias("pair_id"), F.lit(False).alias("chosen"), F.lit(True).alias("rejected")))
    return turns.select(F.explode(F.array_compact(F.array(own, lent))).alias("p"), "turn", "role", "text").select("p.*", "turn", "role", "text")
