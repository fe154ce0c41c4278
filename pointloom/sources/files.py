"""What the point file formats share: listing, record ranges as input partitions, and files written in two phases."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_POINTS = 1_000_000  # points of an input partition
BATCH_POINTS = 100_000
HEADERS_AT_ONCE = 32
FILE_POINTS = 250_000  # points of a written file; a task holds about so many


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def listing(path: str) -> list[str]:
    """The file, or the folder's files by name, hidden ones left out."""
    fs, at = filesystem(path)
    info = fs.get_file_info(at)
    if info.type == pyarrow.fs.FileType.File:
        return [at]
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
    return sorted(x.path for x in found if x.type == pyarrow.fs.FileType.File and not x.base_name.startswith(("_", ".", "attempt-")))


@dataclass
class Points:
    """Where a file's points are: count (None: to be counted), kind of one record, place of the first, and what the format needs to make columns of them.

    chunks are (place, bytes, points) of parts that can only be read whole; lines says that points are lines.
    """

    n: int | None
    record: np.dtype | None = None
    offset: int = 0
    more: dict = field(default_factory=dict)
    chunks: list[tuple[int, int, int]] | None = None
    lines: bool = False


@dataclass
class Range(InputPartition):
    path: str
    first: int
    n: int
    pid: int
    points: Points


class RangeReader(DataSourceReader):
    """Reads records by ranges and compressed points by chunks. A format says how to look at a file and how to make columns.

    The driver opens every file here; pointloom.sources.read_points() leaves that to tasks.
    """

    def __init__(self, path: str, schema, look, columns):
        self.path, self.names, self.look, self.columns = path, [f.name for f in schema.fields], look, columns
        self.kinds = {f.name: arrow_kind(f.dataType.simpleString()) for f in schema.fields}

    def partitions(self) -> Sequence[InputPartition]:
        fs, _ = filesystem(self.path)

        def look(name: str) -> Points:
            with fs.open_input_file(name) as f:
                return self.look(f)

        names = listing(self.path)
        with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
            looked = list(pool.map(look, names))
        out, pid = [], 0
        for name, points in zip(names, looked, strict=True):
            if points.more["columns"] != looked[0].more["columns"]:
                raise ValueError(f"{name} has the columns {points.more['columns']}, the first file has {looked[0].more['columns']}")
            if points.lines:
                raise ValueError(f"{name}: points that are lines are counted by tasks, read them with pointloom.sources.read_points()")
            if points.chunks is None:
                out += [Range(name, k, min(RANGE_POINTS, points.n - k), pid + k, points) for k in range(0, points.n, RANGE_POINTS)]
            else:
                starts = np.cumsum([0, *(n for *_, n in points.chunks)]).tolist()
                out += [Range(name, k, n, pid + k, points) for k, (*_, n) in zip(starts, points.chunks, strict=False)]
            pid += points.n
        return out or [Range("", 0, 0, 0, Points(0))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as f:
            step = BATCH_POINTS if partition.points.chunks is None else partition.n
            for k in range(partition.first, partition.first + partition.n, step):
                n = min(step, partition.first + partition.n - k)
                made = self.columns(f, partition.points, k, n) | {"pid": np.arange(partition.pid + k - partition.first, partition.pid + k - partition.first + n)}
                empty = pa.nulls(n)
                yield pa.RecordBatch.from_arrays([(pa.array(np.ascontiguousarray(made[c])) if c in made else empty).cast(self.kinds[c]) for c in self.names], self.names)


def arrow_kind(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[kind]


def records(f, points: Points, first: int, n: int) -> np.ndarray:
    f.seek(points.offset + first * points.record.itemsize)
    return np.frombuffer(f.read(n * points.record.itemsize), points.record)


def floats(f, at: int, n: int) -> np.ndarray:
    f.seek(at)
    return np.frombuffer(f.read(4 * n), "<f4").astype(np.float64)


@dataclass
class Written(WriterCommitMessage):
    part: int
    paths: list[str]


class PointWriter(DataSourceArrowWriter):
    """Writes files of up to FILE_POINTS points each under attempt names that the driver renames on commit."""

    def __init__(self, path: str, suffix: str, encode):
        self.path, self.suffix, self.encode = path, suffix, encode

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part, paths = TaskContext.get().partitionId(), []
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)

        def put(table: pa.Table) -> None:
            paths.append(f"{root}/attempt-{part}-{len(paths)}-{uuid.uuid4().hex}")
            with fs.open_output_stream(paths[-1]) as out:
                out.write(self.encode({c: table.column(c).to_numpy() for c in table.column_names}, table.num_rows))

        held: list[pa.RecordBatch] = []
        for batch in iterator:
            held.append(batch)
            while sum(b.num_rows for b in held) >= FILE_POINTS:
                table = pa.Table.from_batches(held)
                put(table.slice(0, FILE_POINTS))
                held = table.slice(FILE_POINTS).to_batches()
        if sum(b.num_rows for b in held):
            put(pa.Table.from_batches(held))
        return Written(part, paths)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for k, p in enumerate(m.paths if m else []):
                fs.move(p, f"{root}/part-{m.part:05d}-{k:03d}.{self.suffix}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = filesystem(self.path)
        for m in messages:
            for p in m.paths if m else []:
                fs.delete_file(p)
