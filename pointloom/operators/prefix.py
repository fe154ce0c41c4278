"""Running sums, numbers and ranks within groups, in two levels, so that no task sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.scratch import stored


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, into: str) -> DataFrame:
    """Adds the sum of value over the rows of the group that come before in (bucket, *order).

    Rows are summed within (group, bucket) and bucket totals, of which there are
    few, within the group. The columns of group and bucket hold no nulls.
    """
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumn("__base", F.sum("__total").over(before) - F.col("__total")).drop("__total")
    return df.join(totals, [*group, bucket]).withColumn(into, F.sum(value).over(inner) - F.col(value) + F.col("__base")).drop("__base")


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Adds 1, 2, ... in the given order, ties as they come. Rows are dealt by ranges and numbered per range; only range counts are added up in one place."""
    part = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = part.groupBy("__range").agg(F.count("*").alias("__n"))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("__base", F.sum("__n").over(upto) - F.col("__n")).drop("__n")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return part.join(F.broadcast(counts), "__range").withColumn(into, within + F.col("__base")).drop("__range", "__base")


def last_known(df: DataFrame, group: list[str], order: list[str], value: Column, into: str) -> DataFrame:
    """Adds the value of the row, or of the last one before it in its group that has one; null where none has.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over
    tasks. A range hands the last value of each of its groups to the ranges behind it;
    that is a row for each group and range that meet.
    """
    part = stored(df.withColumn(into, value).repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    ends = part.groupBy(*group, "__range").agg(F.max(F.when(F.col(into).isNotNull(), F.struct(*order, into))).alias("__last"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    held = ends.select(*[F.col(c).alias(f"__{c}") for c in group], F.col("__range").alias("__at"), F.last(F.col("__last")[into], ignorenulls=True).over(before).alias("__held"))
    on = part["__range"] == held["__at"]
    for c in group:
        on &= part[c].eqNullSafe(held[f"__{c}"])
    within = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = part.join(held, on).withColumn(into, F.coalesce(F.last(into, ignorenulls=True).over(within), "__held"))
    return out.select(*[c for c in df.columns if c != into], into)


def ranked(values: DataFrame) -> DataFrame:
    """(name, v, m, before, n) from (name, v): each distinct value of a name, how often it comes, how many values are less and how many there are. Nulls don't count.

    Values are counted first, so repeated ones are one row, and then dealt by ranges.
    """
    counts = values.where(F.col("v").isNotNull()).groupBy("name", "v").agg(F.count("*").alias("m"))
    part = stored(counts.repartitionByRange("name", "v").withColumn("__range", F.spark_partition_id()), "ranges")
    total = part.groupBy("name").agg(F.sum("m").alias("n"))
    return running_sum(part, ["name"], "__range", ["v"], "m", "before").join(total, "name").select("name", "v", "m", "before", "n")


def at_rank(rank: Column) -> Column:
    """Aggregate over rows of ranked(): the value of that rank, counted from 0."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("m")), F.col("v")))


def quantiles(values: DataFrame, at: Sequence[float]) -> DataFrame:
    """(name, q) from (name, v): the interpolated quantiles of each name, an array in the order of `at`."""
    place = [(F.col("n") - 1) * float(p) for p in at]
    near = [a for k, p in enumerate(place) for a in (at_rank(F.floor(p)).alias(f"a{k}"), at_rank(F.ceil(p)).alias(f"b{k}"))]
    between = lambda k, p: F.when(F.col(f"a{k}") == F.col(f"b{k}"), F.col(f"a{k}")).otherwise((F.ceil(p) - p) * F.col(f"a{k}") + (p - F.floor(p)) * F.col(f"b{k}"))
    return ranked(values).groupBy("name", "n").agg(*near).select("name", F.array(*[between(k, p) for k, p in enumerate(place)]).alias("q"))


def named(cloud: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(name, v): the columns of a cloud below one another."""
    return cloud.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), c.cast("double").alias("v")) for k, c in columns.items()])))


def one_row(quantiles: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row with an array column for each name, null where it has no values."""
    return quantiles.groupBy().agg(*[F.max(F.when(F.col("name") == k, F.col("q"))).alias(k) for k in names])
