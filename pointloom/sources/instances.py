"""Instances of a labelled cloud as files: one of raw coordinates for each instance, and labels of all points in pid order.

Instance files hold float32 x, y, z (or other columns) without a header, by pid. An
instance of more than PIECE_POINTS points is dealt to tasks in pieces, each a range of
pids; since the files have no header, pieces one after another are the instance.
They lie in the folder `files`; `instances.json` beside it is a table of lines with
the files of each instance, its count and its heights.

A label file is an int32 for each pid from 0 on. Ranges of pids go to tasks, each of
which knows its place from its first pid; in a local or mounted folder they write into
one file, elsewhere each writes a part and the parts in order are the file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from pointloom.operators.stats import instance_stats
from pointloom.scratch import stored
from pointloom.sources.files import Points, filesystem
from pointloom.sources.formats import PointSource

PIECE_POINTS = 1_000_000
REST = "Other_points"  # fixed value: the file of points in no instance


@dataclass
class _Files(WriterCommitMessage):
    files: list[tuple[str, str]]  # attempt, name


class _InstanceWriter(DataSourceArrowWriter):
    """Rows (file, then the columns to write) come by file."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, str]] = []
        out, now = None, None
        try:
            for batch in iterator:
                names = batch.column("file").dictionary_encode()
                code = names.indices.to_numpy(zero_copy_only=False)
                values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "file"]).astype("<f4")
                starts = np.flatnonzero(np.diff(code, prepend=-1)) if len(code) else []
                for first, stop in zip(starts, [*starts[1:], len(code)], strict=True):
                    name = names.dictionary[int(code[first])].as_py()
                    if name != now:
                        if out:
                            out.close()
                        now = name
                        done.append((f"{root}/attempt-{uuid.uuid4().hex}", f"{root}/{name}"))
                        out = fs.open_output_stream(done[-1][0])
                    out.write(values[first:stop].tobytes())
        finally:
            if out:
                out.close()
        return _Files(done)

    def commit(self, messages: list[_Files | None]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            for attempt, name in m.files if m else []:
                fs.move(attempt, name)

    def abort(self, messages: list[_Files | None]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            for attempt, _ in m.files if m else []:
                fs.delete_file(attempt)


class InstanceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "instance_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _InstanceWriter(self.options["path"])


def write_instance_files(points: DataFrame, path: str, boxes: DataFrame | None = None, columns: tuple[str, ...] = ("x", "y", "z"), piece: int = PIECE_POINTS) -> None:
    """Points (pid, prefix, instance_id, columns...) as {prefix}_{instance_id}.bin, those of a null or zero instance_id as the rest, and the list of them.

    boxes (building_id, corner, x, y, z) are written as Building_{id}_footprint.bin. An
    instance in pieces has files {prefix}_{id}.00000.bin and so on, in pid order.
    """
    spark = points.sparkSession
    spark.dataSource.register(InstanceFiles)
    named = F.when(F.coalesce("instance_id", F.lit(0)) == 0, F.lit(REST)).otherwise(F.concat_ws("_", "prefix", "instance_id"))
    rows = points.select(named.alias("name"), "pid", *columns)
    stats = instance_stats(rows, "name").join(rows.groupBy("name").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi")), "name")
    stats = stored(stats.withColumn("pieces", F.ceil(F.col("count") / piece)), "instances")
    part = F.floor((F.col("pid") - F.col("lo")) * F.col("pieces") / (F.col("hi") - F.col("lo") + 1))
    file = lambda k: F.when(F.col("pieces") == 1, F.concat("name", F.lit(".bin"))).otherwise(F.format_string("%s.%05d.bin", "name", k))
    dealt = rows.join(stats.select("name", "pieces", "lo", "hi"), "name").select(file(part).alias("file"), "pid", *columns)
    dealt = dealt.repartition("file").sortWithinPartitions("file", "pid").drop("pid")
    dealt.write.format("instance_files").mode("append").save(f"{path}/files")
    if boxes is not None:
        corners = boxes.select(F.format_string("Building_%d_footprint.bin", "building_id").alias("file"), "corner", "x", "y", "z")
        corners.repartition("file").sortWithinPartitions("file", "corner").drop("corner").write.format("instance_files").mode("append").save(f"{path}/files")
    listed = F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda k: file(k))
    stats.select("name", "count", "z_min", "z_max", "z_mean", listed.alias("files")).write.mode("overwrite").json(f"{path}/instances.json")


@dataclass
class _Range(WriterCommitMessage):
    first: int
    n: int
    path: str


class _LabelWriter(DataSourceArrowWriter):
    """Rows (pid, label) come by pid, a task's pids without gaps."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        at = f"{root}/attempt-{self.job}" if local else f"{root}/attempt-{uuid.uuid4().hex}"
        out = os.open(at, os.O_CREAT | os.O_WRONLY) if local else fs.open_output_stream(at)
        first = n = 0
        try:
            for batch in iterator:
                pid = batch.column("pid").to_numpy()
                if not len(pid):
                    continue
                first = first if n else int(pid[0])
                if (pid != np.arange(first + n, first + n + len(pid))).any():
                    raise ValueError("labels need pids 0, 1, ... without gaps or repetition")
                data = batch.column("label").to_numpy(zero_copy_only=False).astype("<i4").tobytes()
                if local:  # a task that runs twice writes the same bytes to the same place
                    os.pwrite(out, data, 4 * (first + n))
                else:
                    out.write(data)
                n += len(pid)
        finally:
            os.close(out) if local else out.close()
        return _Range(first, n, at)

    def commit(self, messages: list[_Range | None]) -> None:
        fs, root = filesystem(self.path)
        parts, upto = sorted((m for m in messages if m and m.n), key=lambda m: m.first), 0
        for m in parts:
            if m.first != upto:
                raise ValueError("labels need pids 0, 1, ... without gaps or repetition")
            upto += m.n
        paths = list(dict.fromkeys(m.path for m in parts))
        for k, at in enumerate(paths):
            fs.move(at, f"{root}/labels.bin" if len(paths) == 1 else f"{root}/labels-{k:06d}.bin")

    def abort(self, messages: list[_Range | None]) -> None:
        fs, _ = filesystem(self.path)
        for at in {m.path for m in messages if m}:
            fs.delete_file(at)


class Labels(PointSource):
    """Int32 labels of points 0, 1, ...: reads (pid, label) by ranges; written by write_labels()."""

    @classmethod
    def name(cls) -> str:
        return "labels"

    def found(self) -> list[str]:
        return ["label"]

    def schema(self) -> str:
        return "pid BIGINT, label INT"

    def look(self, f) -> Points:
        return Points(f.size() // 4, np.dtype("<i4"), 0, {"columns": ["label"]})

    def columns(self, f, points: Points, first: int, n: int) -> dict[str, np.ndarray]:
        f.seek(4 * first)
        return {"label": np.frombuffer(f.read(4 * n), "<i4")}

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _LabelWriter(self.options["path"])


def write_labels(labels: DataFrame, path: str) -> None:
    """(pid, label) as one file in pid order; pids are 0, 1, ..., null labels are written as 0."""
    labels.sparkSession.dataSource.register(Labels)
    rows = labels.select(F.col("pid").cast("long").alias("pid"), F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"))
    rows.repartitionByRange("pid").sortWithinPartitions("pid").write.format("labels").mode("append").save(path)
