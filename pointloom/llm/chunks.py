"""Tables of distinct chunks: what a tokenizer does to a chunk it does once per table, and ids join back by position.

A tokenizer whose pieces cannot cross the border between two chunks gives a text
the concatenation of its chunks' ids. Spark splits the texts. A worker keeps one
table from batch to batch and task to task: the first KEPT_CHUNKS distinct
chunks that it meets, frequent ones among them, stay; what comes later is encoded
once for each TABLE_CHUNKS occurrences. So memory is bounded at any input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

TABLE_CHUNKS = 1_000_000
KEPT_CHUNKS = 1 << 19


def slices(batch: pa.RecordBatch, lists: str, most: int = TABLE_CHUNKS) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `most` list elements each, one row at least."""
    ends = np.asarray(batch.column(lists).offsets, dtype=np.int64)[1:]
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else int(batch.column(lists).offsets[0].as_py())
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flattened(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(elements one after another, length of each list)."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for ids in lists for x in ids), np.int32, int(lengths.sum())), lengths


class Table:
    """The ids of chunks, each encoded when it is first met."""

    def __init__(self, encode: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]], most: int = KEPT_CHUNKS):
        """encode gives the ids of chunks one after another, and how many each has."""
        self.encode, self.most, self.place = encode, most, {}
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def look_up(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts in ids, place of each chunk in starts) for distinct chunks."""
        at = np.fromiter((self.place.get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        ids, lengths = self.encode([chunks[k] for k in new]) if len(new) else flattened([])
        flat = np.concatenate([self.flat, ids])
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        at[new] = len(self.place) + np.arange(len(new))
        if room := self.most - len(self.place):
            self.place |= {chunks[k]: int(at[k]) for k in new[:room]}
            self.starts = starts[: len(self.place) + 1]
            self.flat = flat[: self.starts[-1]]
        return flat, starts, at


def ids_by_row(column: pa.ListArray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row offsets into ids) of a column of chunk lists without null lists or chunks."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    found = column.flatten().dictionary_encode()
    flat, starts, place = table.look_up(found.dictionary.to_pylist())
    at = place[found.indices.to_numpy(zero_copy_only=False)]
    sizes = np.diff(starts)[at]
    out = np.concatenate([[0], np.cumsum(sizes)])
    # id k of the output is id (k - out[c]) of the chunk at place c
    ids = flat[np.repeat(starts[at] - out[:-1], sizes) + np.arange(out[-1])]
    return ids, out[offsets]
