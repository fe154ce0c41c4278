"""Point files: data sources, text clouds, and the choice of a reader by a file's first bytes or its name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.inference import summary
from pointloom.operators.prefix import numbered
from pointloom.sources.ranges import catalogue, read_ranges
from pointloom.sources.files import filesystem, listing
from pointloom.sources.formats import Las, LasHeader, Lasd, Obj, Pcbn, Pcd, Ply, RawXyz, Text
from pointloom.scratch import stored

#: First bytes of each format, and file name endings that are read as text.
MAGICS = {b"LASF": "las", b"PCBN": "pcbn", b"ply": "ply", b"#PCD": "pcd", b"# .PCD": "pcd", b"LASD": "lasd"}
TEXT_SUFFIXES = ("txt", "csv", "xyz")
BINARY_SUFFIXES = ("las", "laz", "ply", "pcd", "obj", "bin")

SOURCES = {"rawxyz": RawXyz, "lasd": Lasd, "pcbn": Pcbn, "las": Las, "ply": Ply, "pcd": Pcd, "text": Text, "obj": Obj}


def register(spark: SparkSession) -> None:
    for source in (RawXyz, Lasd, Pcbn, Las, LasHeader, Ply, Pcd):
        spark.dataSource.register(source)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Points of text files (formats.Text), their pids 0, 1, ... by file and line."""
    return read_points(spark, path, kind="text")


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of OBJ files, their pids 0, 1, ... by file and line."""
    return read_points(spark, path, kind="obj")


def format_of(path: str) -> str:
    """The format of a file, or of a folder's first file: by its first bytes, else by its name."""
    fs, _ = filesystem(path)
    name = listing(path)[0]
    with fs.open_input_file(name) as f:
        head = f.read(8)
    for magic, kind in MAGICS.items():
        if head.startswith(magic):
            return kind
    suffix = name.rsplit(".", 1)[-1].lower()
    if suffix == "obj":
        return "obj"
    if suffix in BINARY_SUFFIXES:
        raise ValueError(f"{name}: no known format; read headerless files with format rawxyz and a layout")
    return "text"


def read_points(spark: SparkSession, path: str, box: tuple[Sequence[float], Sequence[float]] | None = None, kind: str | None = None, **options: str) -> DataFrame:
    """A cloud of one file or of all files of a folder, of any format; with a box only the points in it, and files whose head says that they have none aren't read. Tasks open, count and read the files."""
    register(spark)
    source = SOURCES[kind or format_of(path)](options | {"path": path})
    return read_ranges(catalogue(spark, source, path), source, path, box)


def fields_like(headers: DataFrame, word: str) -> DataFrame:
    """(path, name, internal_name) of the fields of las_header rows whose name holds the word in any case; all of them for a blank word."""
    rows = headers.select("path", F.explode(F.concat("available_fields", "extra_dimensions")).alias("f")).select("path", "f.*")
    return rows.where(F.lower("name").contains(word.strip().lower()))


def local_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (*BINARY_SUFFIXES, *TEXT_SUFFIXES)) -> DataFrame:
    """(path, length, modificationTime) of point files, newest first; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return found.where(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$")).orderBy(F.desc("modificationTime"), "path")


def write_instances(points: DataFrame, path: str) -> None:
    """Points by category and instance, one folder each."""
    points.repartition("category", "instance_id").write.partitionBy("category", "instance_id").parquet(path)


def write_metadata(coded: DataFrame, path: str, **facts: str | float | bool | None) -> None:
    """One JSON line about labelled points (las_code, tree_id, building_id): total_points, the given facts, category_summary with points, trees and buildings by code, and instance_summary with the instances and points of trees and buildings."""
    codes = stored(summary(coded), "summary")
    some = lambda c: F.count_distinct(F.when(F.col(c) > 0, F.col(c)))
    whole = coded.agg(F.count("*").alias("total_points"), F.struct(some("tree_id").alias("trees"), some("building_id").alias("buildings"), F.count_if(F.col("tree_id") > 0).alias("tree_points"), F.count_if(F.col("building_id") > 0).alias("building_points")).alias("instance_summary"))
    per = codes.agg(F.array_sort(F.collect_list(F.struct("las_code", "points", "trees", "buildings"))).alias("category_summary"))  # one row per class code
    whole.join(F.broadcast(per)).select("total_points", *[F.lit(v).alias(k) for k, v in facts.items()], "category_summary", "instance_summary").coalesce(1).write.json(path)


def with_pids(cloud: DataFrame, order: list[str]) -> DataFrame:
    """The cloud with pids 0, 1, ... in the given order."""
    return numbered(cloud.drop("pid"), order, "pid").withColumn("pid", F.col("pid") - 1)
