"""Terms of whole texts, split and numbered by Arrow a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def byte_table(separators: bytes = b"") -> bytes:
    """A-Z to a-z, and the given ASCII characters to spaces; bytes of longer characters stay."""
    return bytes(0x20 if b in separators else b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass
class Terms:
    """distinct: the different terms; code, row: number in distinct and row of each term, in the order of the texts; n: terms of each row."""

    distinct: pa.StringArray
    code: np.ndarray
    row: np.ndarray
    n: np.ndarray


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `most` bytes of text each, one row at least."""
    ends = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1].astype(np.int64) if batch.num_rows else np.zeros(1, np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def terms_of(texts: pa.StringArray, table: bytes) -> Terms:
    """The terms of texts without nulls: what stands between white space once the table has been applied."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]
    data = (texts.buffers()[2] or pa.py_buffer(b""))[int(at[0]) : int(at[-1])].to_pybytes().translate(table)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(data))
    lists = pc.ascii_split_whitespace(plain)
    found = lists.flatten().dictionary_encode()
    code = found.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.asarray(lists.offsets)))
    none = pc.index(found.dictionary, "").as_py()
    if none >= 0:  # in front of and behind white space at an end
        some = code != none
        code, row = code[some], row[some]
    return Terms(found.dictionary, code, row, np.bincount(row, minlength=len(texts)))
