"""Business tables seen as point clouds, for queries that have SQL to compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: DuckDB views of the same clouds, to put in front of a query.
EVENTS_SQL = """cloud AS (
    SELECT event_id AS pid, user_id::DOUBLE AS x, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS y, value AS z,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) AS intensity,
           CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 5 WHEN 'purchase' THEN 6 ELSE 1 END AS classification
    FROM events)"""
EMBED_SQL = """cloud AS (
    SELECT vec_id AS pid, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z, label AS classification
    FROM embeddings)"""


def cloud_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("pid"),
        F.col("user_id").cast("double").alias("x"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 3.6e9D").alias("y"),
        F.col("value").alias("z"),
        F.get_json_object("props", "$.k").cast("double").alias("intensity"),
        F.expr("CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 5 WHEN 'purchase' THEN 6 ELSE 1 END").alias("classification"),
    )


def cloud_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("pid"), *[(F.col("embedding")[k].cast("double") * 10).alias(c) for k, c in enumerate("xyz")], F.col("label").alias("classification"))
