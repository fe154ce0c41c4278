"""Tables written to the folder that the driver and all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it is unset, a new local one, but only for a driver that runs its tasks itself, as in tests."""
    at = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="pointloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pointloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and reads it back: later plans start from files that survive lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
