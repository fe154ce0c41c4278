"""A cloud of many files as a table of ranges: tasks open the files, count what must be counted, and read.

1. The driver lists names and opens the first file, for the columns.
2. catalogue(): tasks open the files' heads. A row is a range that one task can read
   alone: some records, a chunk of a compressed file, or SPLIT_BYTES of a file of
   lines. A line belongs to the range in which it begins, so ranges of lines can be
   read apart, and tasks count their points. Sums over the ranges before give each
   range its first pid: pids are 0, 1, ... over all files by name.
3. read_ranges(): ranges go to tasks, which read them. With a box, those whose file
   has bounds in its head that miss the box are left out before anything is dealt.

A file whose columns differ from the first one's is refused.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.scratch import stored
from pointloom.operators.prefix import running_sum
from pointloom.sources.files import BATCH_POINTS, RANGE_POINTS, Points, arrow_kind, filesystem, listing

SPLIT_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20  # of lines that a task parses at once
MOST_TASKS = 1 << 16

RANGE = "file bigint, k bigint, path string, first bigint, n bigint, begin bigint, stop bigint, lo array<double>, hi array<double>, points binary"


def blocks_of_lines(f, body: int, begin: int, stop: int, block: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The lines that begin from `begin` on and before `stop`, some megabytes at a time, whole lines only; lines begin at `body`."""
    at = begin - (begin > body)
    f.seek(at)
    held, started = b"", begin == body
    while at < stop or not started:
        data = f.read(block)
        over = not data
        if not started:  # up to the end of the line that runs into this range
            end = data.find(b"\n")
            at += len(data) if end < 0 else end + 1
            if end < 0:
                if over:
                    return
                continue
            started, data = True, data[end + 1 :]
            if at >= stop:
                return
        held += data
        if at + len(held) >= stop and (end := held.find(b"\n", max(0, stop - 1 - at))) >= 0:
            yield held[: end + 1]
            return
        if over:
            if held:
                yield held
            return
        if cut := held.rfind(b"\n") + 1:
            yield held[:cut]
            at, held = at + cut, held[cut:]


def _ranges(points: Points, size: int) -> Iterator[tuple[int | None, int | None, int | None, int | None]]:
    """(first, n, begin, stop) of each range: of records, or of bytes where points are lines."""
    if points.lines:
        for begin in range(points.offset, size, SPLIT_BYTES):
            yield None, None, begin, min(begin + SPLIT_BYTES, size)
    elif points.chunks is not None:
        first = 0
        for *_, n in points.chunks:
            yield first, n, None, None
            first += n
    else:
        for first in range(0, points.n, RANGE_POINTS):
            yield first, min(RANGE_POINTS, points.n - first), None, None


def catalogue(spark: SparkSession, source, path: str) -> DataFrame:
    """The ranges of all files, with pid, the number of their first point; stored, so that it serves many reads."""
    names = listing(path)
    want = source.found()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(path)
        for batch in batches:
            for file, name in zip(*(batch.column(c).to_pylist() for c in ("file", "path")), strict=True):
                with fs.open_input_file(name) as f:
                    points, size = source.look(f), f.size()
                if points.more["columns"] != want:
                    raise ValueError(f"{name} has the columns {points.more['columns']}, the first file has {want}")
                lo, hi = points.more.get("bounds", (None, None))
                spec = pickle.dumps(points)
                rows = [(file, k, name, *r, lo, hi, spec) for k, r in enumerate(_ranges(points, size))]
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 1000], strict=True), SCHEMA.types, strict=True)], SCHEMA.names)

    files = spark.createDataFrame(list(enumerate(names)), "file bigint, path string")
    found = stored(files.repartition(max(1, min(len(names), MOST_TASKS)), "file").mapInArrow(look, RANGE), "ranges")
    if source.of_lines:
        found = stored(_counted(found, source, path), "counted_ranges")
    return stored(running_sum(found.where("n > 0"), [], "file", ["k"], "n", "pid"), "catalogue")


def _dealt(ranges: DataFrame) -> DataFrame:
    """A partition for each range, as far as that many are of use."""
    return ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)))


def _counted(ranges: DataFrame, source, path: str) -> DataFrame:
    """Ranges of lines with first and n: their points, those beyond the number that a file's head names left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(path)
        for batch in batches:
            n, most = [], []
            for row in batch.select(["path", "begin", "stop", "points"]).to_pylist():
                points = pickle.loads(row["points"])
                with fs.open_input_file(row["path"]) as f:
                    n.append(sum(source.count(points, lines) for lines in blocks_of_lines(f, points.offset, row["begin"], row["stop"])))
                most.append(points.n)
            yield pa.RecordBatch.from_arrays([*batch.select(["file", "k"]).columns, pa.array(n, pa.int64()), pa.array(most, pa.int64())], ["file", "k", "found", "most"])

    # only what counting needs goes to tasks and comes back
    counts = _dealt(ranges.where("begin IS NOT NULL").select("file", "k", "path", "begin", "stop", "points")).mapInArrow(run, "file bigint, k bigint, found bigint, most bigint")
    upto = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("before", F.sum("found").over(upto) - F.col("found"))
    counts = counts.select("file", "k", "before", F.greatest(F.lit(0).cast("long"), F.least("found", F.coalesce("most", F.lit(1 << 62)) - F.col("before"))).alias("found"))
    both = ranges.join(counts, ["file", "k"], "left")
    return both.select("file", "k", "path", F.coalesce("before", "first").alias("first"), F.coalesce("found", "n").alias("n"), "begin", "stop", "lo", "hi", "points")


def range_batches(source, f, points: Points, row: dict, columns: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    """The points of a range, some at a time."""
    if points.lines:
        left = row["n"]
        for lines in blocks_of_lines(f, points.offset, row["begin"], row["stop"]):
            made = source.parsed(points, lines)
            n = min(left, len(made["x"]))
            if n:
                yield {c: v[:n] for c, v in made.items()}
            left -= n
            if not left:
                return
        return
    step = row["n"] if points.chunks is not None else BATCH_POINTS
    for first in range(row["first"], row["first"] + row["n"], step):
        yield source.columns(f, points, first, min(step, row["first"] + row["n"] - first))


def read_ranges(ranges: DataFrame, source, path: str, box: tuple[Sequence[float], Sequence[float]] | None = None, file_column: str = "") -> DataFrame:
    """The points of a catalogue, or those in a box (lower and upper corner, both inside); files whose head says that they miss the box aren't opened. With file_column, each point with its file's name."""
    schema = source.schema() + (f", {file_column} STRING" if file_column else "")
    kinds = [(part.split()[0].strip("`"), arrow_kind(part.split()[1].lower())) for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                points, pid = pickle.loads(row["points"]), row["pid"]
                with fs.open_input_file(row["path"]) as f:
                    for made in range_batches(source, f, points, row, [c for c, _ in kinds]):
                        n = len(made["x"])
                        made["pid"] = np.arange(pid, pid + n)
                        pid += n
                        if file_column:
                            made[file_column] = np.full(n, row["path"].rsplit("/", 1)[-1])
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(made[c])).cast(t) for c, t in kinds], [c for c, _ in kinds])

    if box is not None:
        meets = [F.col("hi")[d] >= float(box[0][d]) for d in range(3)] + [F.col("lo")[d] <= float(box[1][d]) for d in range(3)]
        for m in meets:
            ranges = ranges.where(F.coalesce(m, F.lit(True)))
    cloud = _dealt(ranges).mapInArrow(run, schema)
    if box is not None:
        for d, c in enumerate("xyz"):
            cloud = cloud.where(F.col(c).between(float(box[0][d]), float(box[1][d])))
    return cloud


SCHEMA = pa.schema([("file", pa.int64()), ("k", pa.int64()), ("path", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("points", pa.binary())])
