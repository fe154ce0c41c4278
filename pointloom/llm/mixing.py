"""Mixing sources to target weights.

The words of a source, its documents one after another, are cut into blocks of
BLOCK words. Output shards hold SHARD_SLOTS slots each, and every slot draws its
source by a keyed hash, so the source counts of a shard are one multinomial draw
in the proportion of the targets (counts). Running totals over shards number the
draws of a source, the j-th draw maps through that source's own pseudorandom
permutation to a block, and draws join blocks by (source, block).

A source's draws in all may miss its quota by chance. As far as they miss it by
more than TOLERANCE, or would take a block more than `most` times, its last draws
are handed over to sources that have too few (settled). On large tables chance
stays far under TOLERANCE and this concerns only sources at their cap.

Defined results: null or empty texts have size 0 and nothing is taken of them;
rows with a null source form a source of their own, after all others; null ids
stay null; repeated rows count as often as they come, and ties in the order of
documents are between rows that agree in id and text; a very long text spans many
blocks and no task holds them together; if no text has a word, targets are 0; an
empty table gives an empty result; other columns are carried by mixed() untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.text import WORD, n_words, whole
from pointloom.operators.prefix import running_sum
from pointloom.scratch import fresh, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
TOLERANCE = 0.01
BLOCK = 64
SHARD_SLOTS = 4096
BUCKETS = 4096  # parts of a source whose words are numbered apart
ROUNDS = 10
PART_SLOTS = 1 << 18  # slots that a task draws
UNIT = 1 << 20  # parts of a document that mixed() reckons in


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A keyed pseudorandom permutation of 0..n-1 (swap-or-not): each round swaps a number with its partner or doesn't, by one hashed bit of the pair."""

    def swap(x: Column, k: Column) -> Column:
        y = F.pmod(F.pmod(k, n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, y), k) % 2 == 0, y).otherwise(x)

    return F.aggregate(F.array(*[F.xxhash64(key, F.lit(r)) for r in range(ROUNDS)]), index, swap)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_no, source_size, target) from rows of (source, size).

    Sources in code point order, null last, take the weights in turn. A target
    stops at `most` times its source; the excess goes to the others by weight.
    In order of cap by weight, the first k sources are at their cap, k being the
    least for which the level of the rest stays under all remaining caps.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("source_no", F.row_number().over(by_name).cast("long") - 1)
    per = per.withColumn("weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    upto = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = F.sum("source_size").over(everything) * F.lit(float(share))
    per = per.withColumn("level", (asked - (F.sum("cap").over(upto) - F.col("cap"))) / (F.sum("weight").over(everything) - (F.sum("weight").over(upto) - F.col("weight"))))
    # capped while the level, if no further source were capped, would pass the cap
    per = per.withColumn("free_level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source_no"), F.col("level")))).over(everything)["level"])
    return per.select("source", "source_no", "source_size", F.least(F.col("cap"), F.coalesce(F.col("free_level") * F.col("weight"), F.col("cap"))).alias("target"))


def placed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, source, text_hash, size, bucket): what the mix needs of the documents, without texts; written once."""
    return stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(whole(text)).alias("text_hash"), n_words(whole(text)).alias("size"), F.pmod(F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit(""))), F.lit(BUCKETS)).alias("bucket")), "mixing")


def quotas(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_no, n_blocks, quota, first): what each source should have of the slots, in blocks, as a range of the numbers from 0 on. None passes `most` times the blocks."""
    per = targets.where("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    per = per.withColumn("quota", F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long")).where("quota > 0")
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select("source_no", "n_blocks", "quota", (F.sum("quota").over(upto) - F.col("quota")).alias("first"))


def _parts(spark: SparkSession, n_slots: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n_slots // PART_SLOTS))


def counts(per: DataFrame, n_slots: int, n_sources: int, seed: int = 0) -> DataFrame:
    """(shard, source_no, n): how many slots of each shard draw each source.

    A slot draws a number under n_slots and with it the source whose range has
    that number; ranges are looked up by cells as wide as the mean range.
    """
    spark, width = per.sparkSession, -(-n_slots // max(n_sources, 1)) or 1
    cells = per.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("quota") - 1) / width))))
    drawn = spark.range(0, n_slots, 1, _parts(spark, n_slots)).select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), F.pmod(F.xxhash64(F.lit(seed).cast("long"), "id"), F.lit(n_slots)).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").where((F.col("u") >= F.col("first")) & (F.col("u") < F.col("first") + F.col("quota")))
    return drawn.groupBy("shard", "source_no").agg(F.count("*").alias("n"))


def settled(per: DataFrame, most: float = MOST_EPOCHS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds `final`, near `drawn` and summing up to as much, within tolerance of the quota and at most `most` times the blocks; and where the draws given up and the draws to make up for them begin. One row for each source."""
    low = F.ceil(F.col("quota") * (1 - tolerance)).cast("long")
    high = F.least(F.floor(F.col("quota") * (1 + tolerance)), F.greatest(F.col("quota"), F.floor(F.col("n_blocks") * F.lit(float(most))))).cast("long")
    per = per.withColumn("low", low).withColumn("high", high).withColumn("final", F.greatest("low", F.least("high", "drawn")))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda x: F.sum(x).over(upto) - x
    per = per.withColumn("missing", F.sum("drawn").over(everything) - F.sum("final").over(everything))
    room = F.when(F.col("missing") > 0, F.col("high") - F.col("final")).otherwise(F.col("final") - F.col("low"))
    per = per.withColumn("room", room).withColumn("moved", F.greatest(F.lit(0), F.least(F.col("room"), F.abs("missing") - before(F.col("room")))))
    per = per.withColumn("final", F.col("final") + F.when(F.col("missing") > 0, F.col("moved")).otherwise(-F.col("moved")))
    given, got = F.greatest(F.col("drawn") - F.col("final"), F.lit(0)), F.greatest(F.col("final") - F.col("drawn"), F.lit(0))
    return per.select("source_no", "n_blocks", "quota", "drawn", "final", before(given).alias("given_from"), before(got).alias("got_from"))


def slots(targets: DataFrame, block: int = BLOCK, seed: int = 0, most: float = MOST_EPOCHS) -> DataFrame:
    """(shard, slot, source_no, block_no): the draws of the whole mix."""
    per = stored(quotas(targets, block), "quotas")
    n_slots, n_sources = per.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    n = stored(counts(per, n_slots, n_sources, seed), "counts")
    totals = n.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    per = stored(settled(per.join(totals, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))), most), "settled")
    # places in a shard: sources one after another, then shuffled
    by_source = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = n.withColumn("base", F.sum("n").over(by_source) - F.col("n")).withColumn("bucket", F.floor(F.col("shard") / BUCKETS))
    n = running_sum(n, ["source_no"], "bucket", ["shard"], "n", "before").join(per, "source_no")

    def numbered(rows: DataFrame, first: Column, stop: Column) -> DataFrame:
        rows = rows.where(first < stop).repartition(_parts(per.sparkSession, n_slots), "source_no", "shard")
        rows = rows.withColumn("j", F.explode(F.sequence(first, stop - 1)))
        size = F.least(F.lit(SHARD_SLOTS).cast("long"), F.lit(n_slots) - F.col("shard") * SHARD_SLOTS)
        return rows.withColumn("slot", permuted(F.col("base") + F.col("j") - F.col("before"), size, F.xxhash64(F.lit(seed), "shard")))

    end = F.col("before") + F.col("n")
    kept = numbered(n, F.col("before"), F.least(end, F.col("final"))).select("shard", "slot", "source_no", "n_blocks", "j")
    given = numbered(n, F.greatest("before", "final"), end).select("shard", "slot", (F.col("given_from") + F.col("j") - F.col("final")).alias("k"))
    got = per.where("final > drawn").withColumn("j", F.explode(F.sequence(F.col("drawn"), F.col("final") - 1))).select((F.col("got_from") + F.col("j") - F.col("drawn")).alias("k"), "source_no", "n_blocks", "j")
    draws = kept.unionByName(given.join(got, "k").drop("k"))
    return draws.select("shard", "slot", "source_no", permuted(F.pmod("j", "n_blocks"), F.col("n_blocks"), F.col("source_no") + seed + 1).alias("block_no"))


def pieces(rows: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, source_no, block_no, words, ...): the words that each document has in each block of its source. Sources are matched null-safely."""
    t = targets.select(F.col("source").alias("t_source"), "source_no", "source_size", "target")
    df = rows.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    df = running_sum(df, ["source_no"], "bucket", ["id", "text_hash"], "size", "begin")
    last = F.greatest(F.col("begin") + F.col("size") - 1, F.col("begin"))
    df = df.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor(last / block))))
    inside = F.least(F.col("begin") + F.col("size"), (F.col("block_no") + 1) * block) - F.greatest(F.col("begin"), F.col("block_no") * block)
    return df.withColumn("words", F.greatest(inside, F.lit(0)).cast("long"))


def taken_rows(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 0, **how) -> DataFrame:
    """(id, source, source_no, text_hash, size, source_size, target, taken) for each document."""
    rows = placed(docs, text, id_col, source_col)
    targets = stored(source_targets(rows.select("source", "size"), **how), "targets")
    drawn = slots(targets, seed=seed, most=how.get("most", MOST_EPOCHS)).groupBy("source_no", "block_no").agg(F.count("*").alias("times"))
    # both sides grow with the words, so they are dealt by key and never broadcast
    joined = pieces(rows.withColumn("row", F.monotonically_increasing_id()), targets).join(drawn.hint("merge"), ["source_no", "block_no"], "left")
    out = joined.groupBy("row", "id", "source", "source_no", "text_hash", "size", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    return out.drop("row")


def taken(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 0, **how) -> DataFrame:
    """(id, size, source_size, target, taken) for each document: the words that the mix takes of it, repeats counted."""
    return taken_rows(docs, text, id_col, source_col, seed, **how).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def packed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 0, **how) -> DataFrame:
    """(shard, slot, source_no, block_no, text): the mix itself, a block of at most BLOCK words for each slot, its words joined by spaces."""
    rows = placed(docs, text, id_col, source_col)
    targets = stored(source_targets(rows.select("source", "size"), **how), "targets")
    words = F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))
    said = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(whole(text)).alias("text_hash"), words.alias("said"))
    # repeated rows have the same words: which of them a place belongs to doesn't matter
    said = said.dropDuplicates(["id", "source", "text_hash"]).withColumnsRenamed({"id": "s_id", "source": "s_source", "text_hash": "s_hash"})
    same = F.col("id").eqNullSafe(F.col("s_id")) & F.col("source").eqNullSafe(F.col("s_source")) & (F.col("text_hash") == F.col("s_hash"))
    part = pieces(rows.where("size > 0"), targets).join(said, same)
    first = F.greatest(F.col("block_no") * BLOCK - F.col("begin"), F.lit(0))
    part = part.select("source_no", "block_no", "begin", F.array_join(F.slice("said", (first + 1).cast("int"), F.col("words").cast("int")), " ").alias("part"))
    # a block has BLOCK words, so no more parts than that
    blocks = part.groupBy("source_no", "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "part"))), lambda x: x["part"]), " ").alias("text"))
    return slots(targets, seed=seed, most=how.get("most", MOST_EPOCHS)).join(blocks.hint("merge"), ["source_no", "block_no"]).select("shard", "slot", "source_no", "block_no", "text")


def mixed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 0, **how) -> DataFrame:
    """The mix in whole documents, each as often as the slots took its words, rounded up or down. Columns as given.

    What rounding adds to or takes from one document is carried to the next of its
    source, by size, so that a source's documents come near its target in words.
    """
    keep = docs.columns
    times, key, source, text_hash = (fresh(keep, f"__{x}") for x in ("times", "key", "source", "hash"))
    part = taken_rows(docs, text, id_col, source_col, seed, **how).where("size > 0")
    # rows that agree in id, text and source are repeated rows: one decision for all of them, on what is taken of them together
    part = part.groupBy("id", "text_hash", "source", "source_no").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    part = part.withColumn("share", F.floor(F.col("taken") * UNIT / F.col("size"))).withColumn("bucket", F.floor(F.log2("size")) * 64 + F.pmod(F.xxhash64("id", "text_hash"), F.lit(64)))
    part = running_sum(stored(part, "shares"), ["source_no"], "bucket", ["size", "id", "text_hash"], "share", "before")
    begin = F.col("before") + F.pmod(F.xxhash64("source_no", F.lit(seed + 77)), F.lit(UNIT))
    part = part.select(F.col("id").alias(key), F.col("text_hash").alias(text_hash), F.col("source").alias(source), (F.floor((begin + F.col("share")) / UNIT) - F.floor(begin / UNIT)).cast("int").alias(times)).where(F.col(times) > 0)
    same = docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(whole(docs[text])) == F.col(text_hash)) & docs[source_col].cast("string").eqNullSafe(F.col(source))
    df = docs.join(part.hint("merge"), same).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return df.select(*[F.col(f"`{c}`") for c in keep])
