"""Layers and folders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.scratch import stored


def descendants(folders: DataFrame, root: int, id_col: str = "id", parent: str = "parent") -> DataFrame:
    """(id): the folder and all below it, level by level; a folder that is its own ancestor ends the walk."""
    edges = folders.select(F.col(id_col).alias("id"), F.col(parent).alias("parent"))
    found = front = stored(edges.where(F.col("id") == root).select("id").distinct(), "folders")
    while True:
        front = stored(edges.join(front.withColumnRenamed("id", "above"), F.col("parent") == F.col("above")).select("id").distinct().join(found, "id", "left_anti"), "folders")
        if front.isEmpty():
            return found
        found = stored(found.unionByName(front), "folders")


def visible(layers: DataFrame, folders: DataFrame, codes: list[int] | None = None) -> DataFrame:
    """Layers that are visible, in folders that are, with a class code among `codes` if given."""
    shown = layers.where("visible").join(folders.where("visible").select(F.col("id").alias("folder")), "folder", "left_semi")
    return shown.where(F.col("las_code").isin(codes)) if codes is not None else shown


def without_folder(layers: DataFrame, folders: DataFrame, root: int) -> tuple[DataFrame, DataFrame]:
    """Layers and folders after removal of a folder with all below it."""
    gone = descendants(folders, root)
    return layers.join(gone.withColumnRenamed("id", "folder"), "folder", "left_anti"), folders.join(gone, "id", "left_anti")
