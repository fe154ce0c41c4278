"""Token ids as binary files with Elias-Fano document boundaries, as a Spark data source.

One file holds one range of documents in ascending id order:

    magic "PLID" | u8 version | u8 bytes per id | u16 0
    the ids of all documents, one after another (2 bytes each if the vocabulary allows, else 4)
    ends:    Elias-Fano code of each document's end, in ids from the start of the file
    doc ids: Elias-Fano code of doc_id - least doc_id
    footer:  u64 ids, u64 documents, u64 documents without an id, i64 least doc_id, u64 byte length of ends, u64 of doc ids, magic

An Elias-Fano code of n numbers up to u keeps floor(log2(u / n)) low bits of each
packed, the rest as a bit vector of gaps, and the place of every SAMPLE-th set
bit as u32; a number is found by one select from the nearest sample, in about
2 + log2(u / n) bits a number and without a table of 64-bit offsets.

Tasks write attempt files that the driver renames on commit, and a manifest of
counts per file gives every file its offset in the whole array.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pointloom.llm.chunks import Table, flattened, ids_by_row, slices
from pointloom.llm.text import whole
from pointloom.scratch import new_path

MAGIC = b"PLID"
SAMPLE = 256
FORMAT = "elias_fano_ids"
END_ID = 1
READ_IDS = 1 << 20
JOINED = 256  # chunks encoded in one call
MARK = "\x01"


class EliasFano:
    """A monotone sequence of numbers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shift = np.uint64(low_bits)
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (values >> shift).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> low_bits) + n + 1, np.uint8)
        high[places] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        span = self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes()
        return int.from_bytes(span, "little") >> (first & 7) & ((1 << self.low_bits) - 1)

    def __getitem__(self, i: int) -> int:
        """select(i): from the sample before it, byte by byte."""
        place = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (count := word.bit_count()) <= left:
            left, byte = left - count, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = (byte << 3) + ((word & -word).bit_length() - 1)
        return (place - i) << self.low_bits | self._low(i)

    def block(self, k: int) -> np.ndarray:
        """The numbers from k * SAMPLE on, up to SAMPLE of them: from the k-th sample to the next."""
        first, stop = k * SAMPLE, min(self.n, (k + 1) * SAMPLE)
        place = int(self.samples[k])
        until = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        base = place >> 3
        bits = np.flatnonzero(np.unpackbits(self.high[base : (until + 7) >> 3], bitorder="little")) + 8 * base
        places = bits[bits >= place][: stop - first]
        at = first * self.low_bits
        low = np.unpackbits(self.low[at >> 3 : (stop * self.low_bits + 7) >> 3], bitorder="little")[at & 7 :][: (stop - first) * self.low_bits]
        low = low.reshape(stop - first, self.low_bits).astype(np.int64)
        return (places - np.arange(first, stop) << self.low_bits) + (low << np.arange(self.low_bits)).sum(1)

    def all(self) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int64), *(self.block(k) for k in range(len(self.samples)))])

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        head = struct.calcsize("<QBQQ")
        n, low_bits, n_low, n_high = struct.unpack_from("<QBQQ", data)
        part = np.frombuffer(data, np.uint8, n_low + n_high, head)
        return cls(n, low_bits, part[:n_low], part[n_low:], np.frombuffer(data, "<u4", offset=head + n_low + n_high))


_FOOTER = struct.Struct("<QQQqQQ4s")


class IdFileWriter:
    """Streams documents in ascending id order into one file; only the ends and ids of documents are held."""

    def __init__(self, sink, id_bytes: int):
        self.sink, self.kind = sink, np.dtype(f"<u{id_bytes}")
        self.ends, self.docs, self.n_ids, self.n_null = [], [], 0, 0
        sink.write(MAGIC + struct.pack("<BBH", 1, id_bytes, 0))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.sink.write(ids.astype(self.kind).tobytes())
        self.ends.append(ends + self.n_ids)
        self.n_ids += len(ids)
        self.n_null += doc_ids.null_count
        self.docs.append(doc_ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))

    def close(self) -> tuple[int, int]:
        ends, docs = (np.concatenate([np.empty(0, np.int64), *x]) for x in (self.ends, self.docs))
        least = int(docs[0]) if len(docs) else 0
        gaps = docs.astype(np.uint64) - np.int64(least).astype(np.uint64)  # wraps around as it should
        parts = [EliasFano.of(ends).to_bytes(), EliasFano.of(gaps).to_bytes()]
        self.sink.write(b"".join(parts) + _FOOTER.pack(self.n_ids, len(ends), self.n_null, least, *map(len, parts), MAGIC))
        return self.n_ids, len(ends)


class IdFile:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(0)
        head = source.read(8)
        source.seek(size - _FOOTER.size)
        self.n_ids, self.n_docs, self.n_null, self.least, n_ends, n_docs, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if head[:4] != MAGIC or magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.kind = np.dtype(f"<u{head[5]}")
        source.seek(size - _FOOTER.size - n_docs - n_ends)
        self.ends, self.docs = EliasFano.from_bytes(source.read(n_ends)), EliasFano.from_bytes(source.read(n_docs))

    def span(self, k: int) -> tuple[int, int]:
        """First and last+1 id of the k-th document."""
        return (self.ends[k - 1] if k else 0), self.ends[k]

    def ids(self, start: int, stop: int) -> np.ndarray:
        self.source.seek(8 + start * self.kind.itemsize)
        return np.frombuffer(self.source.read((stop - start) * self.kind.itemsize), self.kind)

    def doc_ids(self, first: int = 0, last: int | None = None) -> pa.Array:
        """Ids of the documents from first to last, without last; those without an id come first."""
        last = self.n_docs if last is None else last
        a, b = max(0, first - self.n_null), max(0, last - self.n_null)
        blocks = [self.docs.block(k) for k in range(a // SAMPLE, -(-b // SAMPLE))] if b > a else []
        gaps = np.concatenate([np.empty(0, np.int64), *blocks])[a % SAMPLE :][: b - a]
        known = pa.array((gaps.astype(np.uint64) + np.int64(self.least).astype(np.uint64)).astype(np.int64), pa.int64())
        return pa.concat_arrays([pa.nulls(max(0, min(last, self.n_null) - first), pa.int64()), known])


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _id_bytes(path: str) -> int:
    t = tokenizer(path)
    return 2 if max(t.get_vocab_size(with_added_tokens=True) - 1, END_ID) < 1 << 16 else 4


def encode_chunks(chunks: Sequence[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each chunk).

    Chunks go to the tokenizer JOINED at a time, a mark between them, whose id tells
    them apart again; where a chunk has that id too, its neighbours and it go one by one.
    """
    t = tokenizer(path)
    lines = [chunks[k : k + JOINED] for k in range(0, len(chunks), JOINED)]
    mark = t.encode(MARK, add_special_tokens=False).ids
    ids, lengths = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for k in range(0, len(lines), 64):
        some = lines[k : k + 64]
        joined = t.encode_batch_fast([f" {MARK} ".join(x) for x in some], add_special_tokens=False)
        for line, found in zip(some, joined, strict=True):
            own = np.array([*found.ids, *mark], np.int32)
            at = np.flatnonzero(own == mark[0]) if len(mark) == 1 else ()
            if len(at) == len(line):
                ids.append(np.delete(own, at))
                lengths.append(np.diff(at, prepend=-1) - 1)
            else:
                one = flattened([x.ids for x in t.encode_batch_fast(line, add_special_tokens=False)])
                ids.append(one[0])
                lengths.append(one[1])
    return np.concatenate(ids), np.concatenate(lengths)


@functools.cache
def table(path: str) -> Table:
    """The worker's table for a tokenizer."""
    return Table(lambda chunks: encode_chunks(chunks, path))


@functools.cache
def splits_at_spaces(path: str) -> bool:
    """Whether the tokenizer drops white space before it looks for pieces, whatever stands around it, so that words can be encoded one by one."""
    spec = json.loads(tokenizer(path).to_str())
    parts = lambda x, kind: [x, *[z for y in x.get(kind, []) for z in parts(y, kind)]] if x else []
    steps = parts(spec["pre_tokenizer"], "pretokenizers")
    keeps = [x for x in parts(spec["normalizer"], "normalizers") if x["type"] not in ("Sequence", "NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace")]
    swaps = [x for x in parts(spec["normalizer"], "normalizers") if x["type"] == "Replace" and (x["pattern"], x["content"]) != ({"Regex": r"\s+"}, " ")]
    drops = [x["type"] in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer") or x["type"] == "Split" and x["invert"] and x["behavior"] == "Removed" and r"\s" in str(x["pattern"]) for x in steps]
    prefix = any(x.get("add_prefix_space") for x in steps)
    return any(drops) and not keeps and not swaps and not prefix and not spec["truncation"]


@dataclass
class _Written(WriterCommitMessage):
    part: int
    path: str
    n_ids: int
    n_docs: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.tokenizer = options["path"], options["tokenizer"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        at = f"{root}/attempt-{part}-{uuid.uuid4().hex}"
        with fs.open_output_stream(at) as sink:
            file = IdFileWriter(sink, _id_bytes(self.tokenizer))
            for batch in iterator:
                for rows in slices(batch, "chunks"):
                    ids, ends = ids_by_row(rows.column("chunks"), table(self.tokenizer))
                    # the end id goes in behind every document
                    file.add(rows.column("doc_id"), np.insert(ids, ends[1:], END_ID), ends[1:] + np.arange(1, rows.num_rows + 1))
            n_ids, n_docs = file.close()
        return _Written(part, at, n_ids, n_docs)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _filesystem(self.path)
        files, base = [], 0
        for m in sorted((m for m in messages if m), key=lambda m: m.part):
            name = f"part-{m.part:06d}.ids"
            fs.move(m.path, f"{root}/{name}")
            files.append({"name": name, "start": base, "ids": m.n_ids, "documents": m.n_docs})
            base += m.n_ids
        with fs.open_output_stream(f"{root}/manifest.json") as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        fs, _ = _filesystem(self.path)
        for m in messages:
            if m:
                fs.delete_file(m.path)


@dataclass
class _Part(InputPartition):
    name: str
    start: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = _filesystem(self.path)
        with fs.open_input_stream(f"{root}/manifest.json") as f:
            return [_Part(x["name"], x["start"]) for x in json.loads(f.read()) if x["documents"]] or [_Part("", 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = _filesystem(self.path)
        with fs.open_input_file(f"{root}/{partition.name}") as source:
            file = IdFile(source)
            for k in range(len(file.ends.samples)):  # offsets of SAMPLE documents at a time, from the code itself
                base = k * SAMPLE
                ends = np.concatenate([[file.ends[base - 1] if k else 0], file.ends.block(k)])
                docs, first = file.doc_ids(base, base + len(ends) - 1), 0
                while first < len(ends) - 1:  # about READ_IDS ids at a time
                    last = max(first + 1, int(np.searchsorted(ends, ends[first] + READ_IDS, side="right")) - 1)
                    data = file.ids(int(ends[first]), int(ends[last])).astype("<u4").tobytes()
                    at = ((ends[first : last + 1] - ends[first]) * 4).astype(np.int32)
                    ids = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([docs.slice(first, last - first), pa.array(ends[first:last] + partition.start), pa.array(np.diff(ends[first : last + 1])), ids], ["doc_id", "start", "n_tokens", "ids_le32"])
                    first = last


class EliasFanoIds(DataSource):
    """Reads (doc_id, start, n_tokens, ids_le32); writes (doc_id, chunks), the chunks being what the tokenizer of the option `tokenizer` encodes one by one."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids_le32 binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def write(docs: DataFrame, path: str, tokenizer_path: str, text: str = "text", id_col: str = "doc_id") -> None:
    """Encodes docs in ascending id order (null ids first, repeated rows one after another) into files under path.

    The tokenizer must split at white space and drop it, so that a text's ids are
    those of its words one after another; one that doesn't is refused. A null or
    empty text has the end id alone; rows that tie by id follow one another in no
    set order; a very long text is cut into words in its task and written whole;
    an empty table gives a manifest without files; columns other than id and text
    are not read, whatever their names.
    """
    if not splits_at_spaces(tokenizer_path):
        raise ValueError("this tokenizer doesn't drop white space; its words can't be encoded apart")
    docs.sparkSession.dataSource.register(EliasFanoIds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    chunks = F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != "")
    rows.select("doc_id", chunks.alias("chunks")).write.format(FORMAT).mode("append").option("tokenizer", tokenizer_path).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_le32): ids as little-endian unsigned 32-bit integers."""
    spark.dataSource.register(EliasFanoIds)
    return spark.read.format(FORMAT).load(path)


def round_trip(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) as read back from files in the shared folder."""
    path = new_path(docs.sparkSession, "ids")
    write(docs, path, tokenizer_path, text, id_col)
    return read(docs.sparkSession, path).select(F.col("doc_id").alias(id_col), "start", "n_tokens", F.crc32("ids_le32").alias("ids_crc32"))
