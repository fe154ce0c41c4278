"""Exact dedup in three stages that never bring a group's rows to one task.

1. Each map task folds equal texts of its own rows (partial aggregation).
2. Its winners meet in groups of (digest, salt), the salt being the input partition.
3. The salt winners, at most `salts` rows a group, meet by digest.
The whole normalised text is part of the grouping key at every stage, so texts
are compared in full and a digest that two texts share splits into two groups.

Defined results: null text counts as empty; null ids rank after all others;
of rows that agree in text and id (repeated rows) one is kept; texts of any
length are compared whole; an empty table gives an empty result; other columns are carried by deduplicated() untouched,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.text import SPACE, sha256_hex, whole
from pointloom.scratch import fresh

SALTS = 32
_IDS = Decimal(10**20)  # more than there are 64-bit ids
_TOP = Decimal(2**63)  # above the largest id


def normalised(text: Column | str) -> Column:
    """The text without white space."""
    return F.regexp_replace(whole(text), SPACE + "+", "")


def _rank(length: Column, doc_id: Column) -> Column:
    """A number that is largest for the longest text, then the smallest id, null last; fits a fixed-width aggregation buffer."""
    tail = F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (length.cast("decimal(11,0)") * F.lit(_IDS).cast("decimal(21,0)") + tail).cast("decimal(38,0)")


def _unrank(rank: Column) -> tuple[Column, Column]:
    """Length and id."""
    ids = F.lit(_IDS).cast("decimal(21,0)")
    tail = (rank % ids).cast("decimal(20,0)")
    return ((rank - tail) / ids).cast("long"), F.when(tail > 0, (F.lit(_TOP).cast("decimal(20,0)") - tail).cast("long"))


def winners(docs: DataFrame, text: str = "text", id_col: str = "doc_id", digest: Callable[[Column], Column] = sha256_hex, salts: int = SALTS) -> DataFrame:
    """(digest, content, keep_id, keep_length, group_size), one row for each distinct normalised text."""
    rows = docs.select(normalised(text).alias("content"), _rank(F.char_length(whole(text)), F.col(id_col)).alias("rank")).select(digest(F.col("content")).alias("digest"), "content", "rank", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "content").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    whole_groups = salted.groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    length, keep_id = _unrank(F.col("rank"))
    return whole_groups.select("digest", "content", keep_id.alias("keep_id"), length.alias("keep_length"), "group_size")


def groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", digest: Callable[[Column], Column] = sha256_hex, compare_members: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each input row.

    Members find their group by digest; AQE splits the group that holds a third of
    the rows. With compare_members (for digests that can collide) by the text as well.
    """
    keys = ["digest", "content"] if compare_members else ["digest"]
    won = winners(docs, text, id_col, digest).select(*keys, "keep_id", "keep_length", "group_size")
    rows = docs.select(F.col(id_col).alias("id"), normalised(text).alias("content"), F.char_length(whole(text)).cast("long").alias("length")).withColumn("digest", digest(F.col("content"))).withColumn("text_sha256", sha256_hex(F.col("content")))
    rows = rows.select("id", "length", "text_sha256", *keys)
    out = rows.join(won, keys)
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
    # dealt anew by id and text: on the join's own key the window would keep AQE from splitting a hot group
    nth = F.row_number().over(Window.partitionBy("id", "text_sha256").orderBy(F.desc("length")))
    return out.withColumn("kept", best & (nth == 1)).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each group, with its own columns. The join's keys hold the winner's id, so a group's rows spread over all tasks."""
    keep = docs.columns
    digest, length, nth, no_id, key = (fresh(keep, f"__{x}") for x in ("digest", "length", "nth", "no_id", "key"))
    keys = [digest, length, no_id, key]
    named = lambda df, i: df.withColumn(no_id, F.col(i).isNull()).withColumn(key, F.coalesce(F.col(i), F.lit(0).cast("long")))
    mine = named(docs.withColumn(digest, sha256_hex(normalised(text))).withColumn(length, F.char_length(whole(text)).cast("long")), f"`{id_col}`")
    won = named(winners(docs, text, id_col).select(F.col("digest").alias(digest), F.col("keep_length").alias(length), "keep_id"), "keep_id").select(*keys)
    # repeated rows share all keys; the window needs no further shuffle, as the join has dealt the rows by the same ones
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in keep])))
    return mine.join(won, keys).withColumn(nth, first).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in keep])
