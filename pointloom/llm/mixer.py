"""Language-model scores by logistic context mixing over the bits of texts.

A text is its class, its lower-cased words, each followed by a space, and an end byte.
Every bit of that is predicted from contexts: its class with the last one to four
bytes of the text, whatever words they are of, with the whole beginning of the word,
and that beginning in any class; in a word's first HEAD bytes also its class with the
four bytes in front of the word and the beginning. So the bits of a word's first HEAD
bytes depend on the class, on those and on the four bytes before (a joint), and the
bits behind them on the word and the class alone: each distinct joint and each
distinct word of a class is counted, learned from and scored once, and its score goes
to the texts that hold it, by how often they do. Together they are the bits of the
text, read in its order.

1. Classes: texts have a profile, the histogram of hashed byte pairs; those of the
   training texts are clustered (centroids.py). The nearest centroid of a text is its
   class, in effect its language or kind.
2. word_counts(): how often each word of a class (the class as a digit in front of the
   word) and each joint stands in all, in training and in tuning texts, an eighth of
   those in training.
3. Bit predictors: a hashed table of (zeros, ones) for each context and bits so far in
   a byte, from the training texts without the tuning texts; tasks count, and chunks of
   their tables are added up. The table has 16 to 32 slots for a word or joint,
   2 ** MOST_BITS at most. A context is hashed once for each half of a byte, whose four
   bits have their slots side by side.
4. Mixing, learned online by each task over the tuning words and joints, in batches:
   predictions go in as stretched probabilities, weights are chosen by a gate (how far
   the longest known contexts reach, whether in a joint, and the bit), and each batch
   moves them after it has been predicted. Then an adaptive map from (gate, mixed probability) to what really came
   refines the result. Spark averages the tasks' weights by what they have seen and adds
   up the maps.
5. Every word is scored. Bits of a text are those of its class and the sum over its
   joints and words; each bit's two probabilities sum to one, words end by a byte that none holds
   and a text has one class, so texts' probabilities do not sum to more than one.
6. Texts meet their words' counts and scores: words with at least 1 / FREQUENT of all
   occurrences (at most FREQUENT of them, of at most FREQUENT times the mean length)
   are broadcast, and the others are joined by word. So no frequent word is shuffled.
   Scores of the most frequent joints, 2 * FREQUENT at most, are broadcast too; the
   others are scored again in each slice of texts that holds them.

Defined results: null and empty texts have the end alone; a null id has the hash of
the empty text, which is in training; repeated rows each count and each give a row;
words of any length are read whole; other columns are not read; an empty table gives
an empty result. Weights are averages over tasks, so the last digits of a score
depend on how words are dealt to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm import centroids
from pointloom.llm.text import whole
from pointloom.llm.tokens import Terms, byte_table, terms_of, text_slices
from pointloom.scratch import stored

FOLDS, HELD_OUT = 5, 1
TUNING = 8  # one training text in so many
CLASSES = 8
PROFILE = centroids.DIMS
PROFILE_BYTES = 1 << 20
END = "\n"  # no word holds white space
TABLE = byte_table()
ORDERS = 7  # contexts: 1 to 4 bytes, the whole beginning in the class and in all, in joints that behind four bytes
HEAD = 4  # bytes of a word that belong to its joint
JOINTS = 1 << 16  # for which all bits are held at once
MOST_BITS = 23  # of the table's slots
CHUNK = 1 << 14  # slots of a row
SLICE_BYTES = 1 << 18  # of words, for which all bits are held at once
BATCH = 2048  # bytes between two steps of the mixing weights
REACH, LEVELS = 12.0, 33  # stretched probabilities run to +-REACH, in maps of LEVELS steps
GATES = 5 * 4 * 2
RATE = 0.05
FREQUENT = 1 << 20
PRIOR = 0.05  # of either bit, before any was seen
FINE = 2048  # steps of a stretched probability in a table
SURE = np.searchsorted([1, 3, 7], np.arange(16), side="right").astype(np.uint8)  # what a slot's size says in a gate
PART = 1 << 12  # bytes that are counted or scored at once, so that what is made of them stays in a core's cache


def hashed(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def profiles(texts: pa.StringArray) -> np.ndarray:
    """Roots of the shares of hashed byte pairs, a row for each text; of a text without a pair, zeros."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]
    data = (texts.buffers()[2] or pa.py_buffer(b""))[int(at[0]) : int(at[-1])].to_pybytes().translate(TABLE)
    at = at.astype(np.int64) - int(at[0])
    byte, counts, first = np.frombuffer(data, np.uint8), np.zeros((len(texts), PROFILE), np.int64), 0
    while first < len(texts):  # about PROFILE_BYTES at a time, one text at least
        last = max(first + 1, int(np.searchsorted(at, at[first] + PROFILE_BYTES, side="right")) - 1)
        part = byte[at[first] : at[last]].astype(np.int32)
        row = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(at[first : last + 1]))
        pair = ((part[:-1] * 40503 + part[1:] * 10007) >> 6) % PROFILE
        counts[first:last] = np.bincount((row[1:] * PROFILE + pair)[row[1:] == row[:-1]], minlength=(last - first) * PROFILE).reshape(-1, PROFILE)
        first = last
    return np.sqrt(counts / np.maximum(counts.sum(1), 1)[:, None])


def class_centroids(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> np.ndarray:
    """Centroids of the training texts' profiles; a row of zeros where there is no such text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                at = pa.array(np.arange(part.num_rows + 1) * PROFILE, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("h"), pa.ListArray.from_arrays(at, pa.array(profiles(part.column("text")).ravel(), pa.float32()))], ["h", "profile"])

    rows = docs.select(hashed(F.col(id_col)).alias("h"), whole(text).alias("text")).where(F.col("h") % FOLDS != HELD_OUT)
    found = centroids.clustered(stored(rows.mapInArrow(run, "h bigint, profile array<float>"), "profiles"), "profile", "h", k=CLASSES)[1]
    return found if len(found) else np.zeros((1, PROFILE), np.int64)


@dataclass
class Keyed:
    """distinct: the different words of a class, the class in front; code, row: number in distinct and row of each word; joints: the different ones; joint, joint_row: number in joints and row of each; n: words, size: their bytes in each row; of: class of each row."""

    distinct: pa.StringArray
    code: np.ndarray
    row: np.ndarray
    joints: np.ndarray
    joint: np.ndarray
    joint_row: np.ndarray
    n: np.ndarray
    size: np.ndarray
    of: np.ndarray


DIGITS = pa.array([str(k) for k in range(CLASSES)])


def edges(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first HEAD bytes of each word with its space, its last three bytes, both filled up with spaces, its length)."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][: len(words) + 1].astype(np.int64)
    data = np.append(np.frombuffer(words.buffers()[2] or b"", np.uint8), np.uint8(32))
    first, last = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for k in range(HEAD):
        first = (first << np.uint64(8)) | np.where(at[:-1] + k < at[1:], data[np.minimum(at[:-1] + k, len(data) - 1)], np.uint64(32))
    for k in range(3, 0, -1):
        last = (last << np.uint64(8)) | np.where(at[1:] - k >= at[:-1], data[np.maximum(at[1:] - k, 0)], np.uint64(32))
    return first, last, np.diff(at)


def joints_of(t: Terms, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(joint, row) of all words and ends of the texts, the words' first.

    A joint has eight bytes: the class as a digit, the three bytes of the text in front of the space before
    the word, spaces where the text begins, and the first HEAD bytes of the word and its space, or END, filled
    up with spaces. No word holds a space, so a joint says where its word ends.
    """
    first, last, length = edges(t.distinct)
    first, up_to, start = first[t.code], last[t.code], np.uint64(0x202020)
    begins = np.append(np.ones(min(1, len(t.row)), bool), t.row[1:] != t.row[:-1])
    # three bytes up to the end of each word: those of a word of one byte reach into the word before
    short = np.flatnonzero((length == 1)[t.code] & ~begins)
    up_to[short] = ((up_to[short - 1] & np.uint64(0xFF)) << np.uint64(16)) | (up_to[short] & np.uint64(0xFFFF))
    tail = np.empty_like(up_to)
    tail[1:] = up_to[:-1]
    tail[begins] = start
    rows = np.arange(len(of))
    at_end = np.full(len(of), start)
    at_end[t.row] = up_to  # of the last word
    digit = (of + 48).astype(np.uint64) << np.uint64(24)
    end = np.uint64(int.from_bytes(END.encode().ljust(HEAD), "big"))
    joints = [((d | x) << np.uint64(32)) | h for d, x, h in ((digit[t.row], tail, first), (digit, at_end, end))]
    return np.concatenate(joints).view(np.int64), np.concatenate([t.row, rows])


def keyed(texts: pa.StringArray, middles: np.ndarray) -> Keyed:
    t = terms_of(texts, TABLE)
    of = centroids.squared(np.floor(profiles(texts) * centroids.SCALE).astype(np.int64), middles).argmin(1)
    pairs, seen = of[t.row] * np.int64(len(t.distinct)) + t.code, np.zeros(CLASSES * len(t.distinct), bool)
    seen[pairs] = True
    kind, word = np.divmod(np.flatnonzero(seen), max(len(t.distinct), 1))
    code = (np.cumsum(seen) - 1)[pairs]
    size = pc.binary_length(t.distinct).to_numpy(zero_copy_only=False)[t.code]
    joints, joint_row = joints_of(t, of)
    joints, joint = np.unique(joints, return_inverse=True)
    distinct = pc.binary_join_element_wise(DIGITS.take(pa.array(kind)), t.distinct.take(pa.array(word)), "")
    return Keyed(distinct, code, t.row, joints, joint, joint_row, t.n, np.bincount(t.row, size + 1, len(texts)).astype(np.int64), of)


def word_counts(docs: DataFrame, middles: np.ndarray, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, joint, n_all, n_train, n_tune) of the words of each class, joint null, the end of a text being a word too, and of the joints, word null."""
    numbers = ["n_all", "n_train", "n_tune"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                t, h = keyed(part.column("text"), middles), part.column("h").to_numpy()
                train = (h % FOLDS != HELD_OUT).astype(np.float64)
                tune = train * (h // FOLDS % TUNING == 0)
                kinds = (np.ones(part.num_rows), train, tune)
                n = [np.append(np.bincount(t.code, w[t.row], len(t.distinct)), np.bincount(t.of, w, CLASSES)).astype(np.int64) for w in kinds]
                words = pa.concat_arrays([t.distinct, pa.array([f"{k}{END}" for k in range(CLASSES)])])
                yield pa.RecordBatch.from_arrays([words, pa.nulls(len(words), pa.int64()), *map(pa.array, n)], ["word", "joint", *numbers])
                n = [np.bincount(t.joint, w[t.joint_row], len(t.joints)).astype(np.int64) for w in kinds]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(t.joints), pa.string()), pa.array(t.joints), *map(pa.array, n)], ["word", "joint", *numbers])

    rows = docs.select(hashed(F.col(id_col)).alias("h"), whole(text).alias("text"))
    parts = rows.mapInArrow(run, "word string, joint bigint, n_all bigint, n_train bigint, n_tune bigint")
    return parts.groupBy("word", "joint").agg(*[F.sum(c).alias(c) for c in numbers]).where("n_all > 0")


def known_words(counts: DataFrame) -> DataFrame:
    """The words of word_counts() with n_word, which counts the word in the training texts of all classes, and first, which says so for one class of each word."""
    same = Window.partitionBy(F.substring("word", 2, 1 << 30))  # CLASSES rows at most
    return counts.where("joint IS NULL").drop("joint").withColumns({"n_word": F.sum("n_train").over(same), "first": F.col("word") == F.min("word").over(same)})


POWER = 0x9E3779B97F4A7C15


class Bits:
    """The bits of words behind their class, from the byte `skip` on, and the slots of their contexts."""

    def __init__(self, words: pa.StringArray, table_bits: int, skip: int = 0):
        ended = pc.binary_join_element_wise(words, pc.if_else(pc.ends_with(words, END), "", " "), "")
        at = np.frombuffer(ended.buffers()[1], np.int32)[: len(ended) + 1].astype(np.int64)
        data = np.frombuffer(ended.buffers()[2] or b"", np.uint8)[: at[-1]]
        own = np.ones(len(data), bool)
        own[at[:-1]] = False  # the class
        kind, at = data[at[:-1]].astype(np.uint64), at - np.arange(len(at))
        byte = data[own]
        word = np.repeat(np.arange(len(words)), np.diff(at))
        place = np.arange(len(byte)) - at[word]
        before = np.concatenate([np.full(4, 32, np.uint8), byte]).astype(np.uint64)
        # a sum of bytes times powers by place, without the byte itself; wraps around as it should
        power = np.full(int(place.max(initial=0)) + 1, POWER, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((byte.astype(np.uint64) + np.uint64(1)) * power[place], dtype=np.uint64)])
        start = sums[:-1] - sums[at[word]]
        last = [np.where(place >= k, before[4 - k : len(before) - k], np.uint64(32)) for k in range(1, 5)]
        some = np.flatnonzero(place >= skip) if skip else slice(None)
        self._set(byte[some], word[some], table_bits, kind[word][some], [x[some] for x in last], start[some], [])

    @classmethod
    def of_joints(cls, joints: np.ndarray, table_bits: int) -> Bits:
        """The bits of the joints' words."""
        own = joints.astype(">i8").view(np.uint8).reshape(-1, 8)
        space = np.full((len(own), 1), 32, np.uint8)
        data = np.hstack([own[:, 1:4], space, own[:, 4:]]).astype(np.uint64)  # the last four bytes and the first HEAD
        head = data[:, 4:]
        more = (head != 32) & (head != ord(END))
        coded = np.hstack([np.ones((len(own), 1), bool), np.logical_and.accumulate(more, 1)[:, :-1]])
        power = np.cumprod(np.array([1] + [POWER] * (HEAD - 1), np.uint64), dtype=np.uint64)
        start = np.hstack([np.zeros((len(own), 1), np.uint64), np.cumsum((head + np.uint64(1)) * power, 1, dtype=np.uint64)[:, :-1]])[coded]
        word = np.nonzero(coded)[0]
        bits = cls.__new__(cls)
        ahead = (joints.view(np.uint64) >> np.uint64(32))[word] * np.uint64(0xA0761D6478BD642F)
        bits._set(head[coded].astype(np.uint8), word, table_bits, own[word, 0].astype(np.uint64), [data[:, 4 - k : 4 - k + HEAD][coded] for k in range(1, 5)], start, [start + ahead])
        return bits

    def _set(self, byte: np.ndarray, word: np.ndarray, table_bits: int, kind: np.ndarray, last: list[np.ndarray], start: np.ndarray, more: list[np.ndarray]) -> None:
        self.byte, self.word, self.table_bits = byte, word, table_bits
        seen, contexts = kind, []
        for x in last:
            seen = (seen << np.uint64(8)) | x
            contexts.append(seen)
        contexts += [start ^ (kind << np.uint64(56)), start, *more]
        self.contexts = [(c + np.uint64(k + 1)) * np.uint64(0xC2B2AE3D27D4EB4F) for k, c in enumerate(contexts)]

    def halves(self, half: int, part: slice = slice(None)) -> list[np.ndarray]:
        """The hash of each context with the first half of each byte, if half is 1: the 16 slots around it are those of the half's bits."""
        node = (self.byte[part].astype(np.uint64) | np.uint64(256)) >> np.uint64(8 - 4 * half)
        turned, found = node * np.uint64(0xD6E8FEB86659FD93), []
        for c in self.contexts:
            h = (c[part] ^ turned) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
            h >>= np.uint64(64 - self.table_bits)
            found.append(h.view(np.int64))
        return found

    def slots(self, bit: int, part: slice = slice(None), halves: list[np.ndarray] | None = None) -> Iterator[np.ndarray]:
        """The slot of each context for the bit that follows the first `bit` bits of each byte; halves, if given, are those of the bit's half."""
        node = self.node(bit, part)
        for h in self.halves(bit // 4, part) if halves is None else halves:
            yield h ^ node

    def node(self, bit: int, part: slice = slice(None)) -> np.ndarray:
        """1 to 15 for what the bits of its half before this one were, so that no two of a half share a slot."""
        return ((self.byte[part] >> (4 - bit // 4 * 4) & 15).astype(np.int64) | 16) >> (4 - bit % 4)

    def value(self, bit: int, part: slice = slice(None)) -> np.ndarray:
        return self.byte[part] >> (7 - bit) & 1

    def steps(self, part: slice = slice(None)) -> Iterator[tuple[int, list[np.ndarray]]]:
        """The bits of a byte, each with its half's hashes, which are made once."""
        for bit in range(8):
            halves = self.halves(bit // 4, part) if bit % 4 == 0 else halves  # noqa: F821
            yield bit, halves


def word_slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    return text_slices(batch, "word", most)


def unit_slices(batch: pa.RecordBatch, table_bits: int) -> Iterator[tuple[pa.RecordBatch, Bits]]:
    """Parts of a batch of words and joints, each of either, with their bits."""
    of_word = pc.is_null(batch.column("joint"))
    for part in word_slices(batch.filter(of_word)):
        yield part, Bits(part.column("word"), table_bits, HEAD)
    joints = batch.filter(pc.invert(of_word))
    for first in range(0, joints.num_rows, JOINTS):
        part = joints.slice(first, JOINTS)
        yield part, Bits.of_joints(part.column("joint").to_numpy(), table_bits)


def bit_tables(counts: DataFrame, table_bits: int) -> DataFrame:
    """(chunk, slots): stretched probabilities and sizes of the slots of a chunk."""
    n_slots = 1 << table_bits
    chunk = min(CHUNK, n_slots)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for part, bits in unit_slices(batch, table_bits):
                table = np.zeros(n_slots * 2, np.float32) if table is None else table
                n = part.column("n").to_numpy().astype(np.float32)
                long = 3 if len(bits.contexts) < ORDERS else ORDERS - 2  # the heads of all words make few beginnings
                for first in range(0, len(bits.byte), PART):
                    own = slice(first, first + PART)
                    once = n[bits.word[own]]
                    again = np.where(once > 1, once, np.float32(0))  # words and joints that occur once are no beginnings to rely on
                    for half in range(2):
                        ways = [bits.node(b, own) * 2 + bits.value(b, own) for b in range(4 * half, 4 * half + 4)]
                        for k, h in enumerate(bits.halves(half, own)):
                            for way in ways:  # slot * 2 + one
                                np.add.at(table, (h * 2) ^ way, again if k > long else once)
        for k in range(n_slots // chunk) if table is not None else ():
            own = table[k * chunk * 2 : (k + 1) * chunk * 2]
            if len(place := np.flatnonzero(own)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([place.astype("<u2").tobytes()]), pa.array([own[place].astype("<f4").tobytes()])], ["chunk", "place", "n"])

    def finish(k: int, total: np.ndarray) -> pa.RecordBatch:
        own = total.reshape(chunk, 2)
        n = own.sum(1)
        p = (own[:, 1] + PRIOR) / (n + 2 * PRIOR)
        size = np.minimum(15, np.ceil(np.log2(n + 1.0))).astype(np.uint8)
        stretched = np.rint(np.clip(np.log(p / (1 - p)), -REACH, REACH) * FINE).astype("<i2")
        stretched[(n > 0) & (stretched == 0)] = 1  # zero says that nothing was counted
        data = stretched.tobytes() + size.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data])], ["chunk", "slots"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(chunk * 2)
        for batch in batches:  # rows come by chunk
            for k, place, n in zip(batch.column("chunk").to_pylist(), batch.column("place"), batch.column("n"), strict=True):
                if k != now and now is not None:
                    yield finish(now, total)
                    total = np.zeros(chunk * 2)
                now = k
                total[np.frombuffer(place.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), "<f4")
        if now is not None:
            yield finish(now, total)

    parts = counts.select("word", "joint", (F.col("n_train") - F.col("n_tune")).alias("n")).where("n > 0").mapInArrow(count, "chunk int, place binary, n binary")
    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, slots binary")


class Tables:
    """Stretched probability and size (0 to 15, a logarithm) of every slot."""

    def __init__(self, table_bits: int, chunks: list[tuple[int, bytes]]):
        self.table_bits = table_bits
        n = 1 << table_bits
        self.stretched, self.size = np.zeros(n, np.int16), np.zeros(n, np.uint8)
        chunk = min(CHUNK, n)
        for k, data in chunks:
            self.stretched[k * chunk : (k + 1) * chunk] = np.frombuffer(data, "<i2", chunk)
            self.size[k * chunk : (k + 1) * chunk] = np.frombuffer(data, np.uint8, offset=2 * chunk)

    def inputs(self, bits: Bits, bit: int, part: slice, halves: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(stretched probabilities of the contexts and a constant, a row each; gate)."""
        n = len(bits.byte[part])
        x, gate = np.zeros((ORDERS + 1, n), np.float32), np.zeros(n, np.uint8)
        for k, slot in enumerate(bits.slots(bit, part, halves)):
            found = self.stretched[slot]
            np.multiply(found, np.float32(1 / FINE), out=x[k])
            if k < 4:  # a slot that something was counted in holds no zero
                np.maximum(gate, (found != 0).view(np.uint8) * np.uint8(4 * (k + 1)), out=gate)
            elif k == 4:
                gate += SURE[self.size[slot]]
        x[ORDERS] = 0.3
        return x, gate.astype(np.int64) + (20 if len(bits.contexts) == ORDERS else 0)


def squashed(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -REACH, REACH)))


class Mix:
    """Mixing weights by gate and bit, and the adaptive map by gate and mixed probability."""

    def __init__(self):
        self.weights = np.full((GATES * 8, ORDERS + 1), 0.25)
        self.mass, self.steps = np.zeros(GATES * 8), np.zeros(GATES * 8)
        levels = squashed(np.linspace(-REACH, REACH, LEVELS))
        self.ones, self.all = np.tile(levels, (GATES, 1)).ravel() * 4, np.full(GATES * LEVELS, 4.0)

    def predict(self, x: np.ndarray, gate: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(probability of a one, that before the map, lower level of the map, share of the upper level)."""
        own, weights, t = gate * 8 + bit, self.weights.T.astype(np.float32, order="C"), np.zeros(len(gate), np.float32)
        for k in range(ORDERS + 1):
            t += x[k] * weights[k][own]
        np.clip(t, -REACH + 1e-4, REACH - 1e-4, out=t)
        place = (t + np.float32(REACH)) * np.float32((LEVELS - 1) / (2 * REACH))
        low = place.astype(np.int64)
        share, low = place - low, low + gate * LEVELS
        level = self.ones / self.all
        mixed = squashed(t).astype(np.float64)
        return np.clip((mixed + level[low] + share * np.diff(level, append=0)[low]) / 2, 1e-6, 1 - 1e-6), mixed, low, share

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: int, one: np.ndarray, n: np.ndarray) -> None:
        """One step: predict, then move weights and map towards what came, n times each."""
        _, mixed, low, share = self.predict(x, gate, bit)
        own = gate * 8 + bit
        mass = np.bincount(own, n, len(self.mass))
        has = np.flatnonzero(mass)
        pull = (one - mixed) * n
        for k in range(ORDERS + 1):
            self.weights[has, k] += (RATE / np.sqrt(1 + self.steps[has] / 20)) * np.bincount(own, pull * x[k], len(mass))[has] / mass[has]
        self.mass += mass
        self.steps[has] += 1
        for at, w in ((low, (1 - share) * n), (low + 1, share * n)):
            self.all += np.bincount(at, w, len(self.all))
            self.ones += np.bincount(at, w * one, len(self.all))


def learned(counts: DataFrame, tables) -> Mix:
    """The mix of all tasks; tables is a broadcast of Tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, start = Mix(), Mix()
        for batch in batches:
            for units, bits in unit_slices(batch, tables.value.table_bits):
                n = units.column("n_tune").to_numpy().astype(np.float64)
                for first in range(0, len(bits.byte), BATCH):
                    part = slice(first, first + BATCH)
                    for b, halves in bits.steps(part):
                        mix.learn(*tables.value.inputs(bits, b, part, halves), b, bits.value(b, part), n[bits.word[part]])
        weights = (mix.weights * mix.mass[:, None]).ravel()
        for kind, values in enumerate((weights, mix.mass, mix.ones - start.ones, mix.all - start.all)):
            some = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind), pa.int32()), pa.array(some, pa.int32()), pa.array(values[some])], ["kind", "place", "value"])

    # by hash: the words come in no order that says something of them
    rows = counts.where("n_tune > 0").select("word", "joint", "n_tune", F.xxhash64("word", "joint").alias("h")).sortWithinPartitions("h").drop("h")
    mix = Mix()
    total = [np.zeros(mix.weights.size), np.zeros(mix.mass.size), np.zeros(mix.ones.size), np.zeros(mix.all.size)]
    for r in rows.mapInArrow(run, "kind int, place int, value double").groupBy("kind", "place").agg(F.sum("value").alias("value")).collect():  # as many rows as a mix has numbers
        total[r.kind][r.place] = r.value
    has = total[1] > 0
    mix.weights[has] = total[0].reshape(mix.weights.shape)[has] / total[1][has, None]
    mix.ones, mix.all = mix.ones + total[2], mix.all + total[3]
    return mix


def cost_of(bits: Bits, n: int, tables: Tables, mix: Mix) -> np.ndarray:
    """What the bits cost, summed for each of n words or joints."""
    chance = np.ones(len(bits.byte))  # of each byte, 1e-48 at least
    for first in range(0, len(chance), PART):
        part = slice(first, first + PART)
        for b, halves in bits.steps(part):
            p = mix.predict(*tables.inputs(bits, b, part, halves), b)[0]
            chance[part] *= np.where(bits.value(b, part) == 1, p, 1 - p)
    return np.bincount(bits.word, -np.log2(chance), n).astype(np.float64)


def word_bits(words: pa.StringArray, tables: Tables, mix: Mix, skip: int = 0) -> np.ndarray:
    """Bits that each word costs from its byte `skip` on, with the space behind it."""
    return cost_of(Bits(words, tables.table_bits, skip), len(words), tables, mix)


def joint_bits(joints: np.ndarray, tables: Tables, mix: Mix) -> np.ndarray:
    """Bits that the words' first HEAD bytes cost behind what the joints have in front of them."""
    parts = [joints[k : k + JOINTS] for k in range(0, len(joints), JOINTS)]
    return np.concatenate([np.zeros(0), *(cost_of(Bits.of_joints(j, tables.table_bits), len(j), tables, mix) for j in parts)])


def model(counts: DataFrame) -> tuple:
    """(broadcast of the tables, mix)."""
    n_words = counts.where("n_train > 0").count()
    table_bits = min(MOST_BITS, max(10, math.ceil(math.log2(n_words + 1)) + 4))
    chunks = bit_tables(counts, table_bits).collect()  # 2 ** MOST_BITS slots of 3 bytes at most
    tables = counts.sparkSession.sparkContext.broadcast(Tables(table_bits, [(r.chunk, bytes(r.slots)) for r in chunks]))
    return tables, learned(counts, tables)


def word_scores(words: DataFrame, tables, mix: Mix) -> DataFrame:
    """(word, n_all, n_word, bits), bits being those behind the first HEAD bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in word_slices(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("word", "n_all", "n_word")), pa.array(word_bits(part.column("word"), tables.value, mix, HEAD))], ["word", "n_all", "n_word", "bits"])

    return words.select("word", "n_all", "n_word").mapInArrow(run, "word string, n_all bigint, n_word bigint, bits double")


def most_frequent(joints: DataFrame, most: int) -> DataFrame:
    """At most so many joints: all that occur so often that there are no more."""
    # as many rows as there are different counts, the root of twice the tokens at most
    steps = sorted(((r.n_all, r["count"]) for r in joints.groupBy("n_all").count().collect()), reverse=True)
    within = np.cumsum([n for _, n in steps]) <= most
    return joints.where(F.col("n_all") >= min((n for (n, _), fits in zip(steps, within, strict=True) if fits), default=1 << 62))


def joint_scores(joints: DataFrame, tables, mix: Mix) -> DataFrame:
    """(joint, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("joint"), pa.array(joint_bits(batch.column("joint").to_numpy(), tables.value, mix))], ["joint", "bits"])

    return joints.select("joint").mapInArrow(run, "joint bigint, bits double")


def scored(docs: DataFrame, text: str = "text", id_col: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte): score is log10 of the model's probability, base_score that of single tokens by their counts."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    middles = class_centroids(docs, text, id_col)
    counts = stored(word_counts(docs, middles, text, id_col), "word_counts")
    tables, mix = model(counts)
    own = stored(known_words(counts), "known_words")
    words = stored(word_scores(own, tables, mix), "word_scores")
    n_all, n_train, n_words = own.agg(F.sum("n_all"), F.sum("n_train"), F.count_if(F.col("first") & (F.col("n_word") > 0))).first()
    if not n_all:  # no text at all
        return spark.createDataFrame([], f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double")
    of_all = math.log10(n_train + 0.5 * (n_words + 1))
    # the end of a text and its class: a row per class
    ends, in_class = np.zeros((CLASSES, 2)), np.full(CLASSES, 0.5)
    for r in words.where(F.substring("word", 2, 1) == END).collect():
        ends[int(r.word[0])] = r.n_word, r.bits
    for r in own.where(F.substring("word", 2, 1) == END).collect():
        in_class[int(r.word[0])] += r.n_train
    ends[:, 1] -= np.log2(in_class / in_class.sum())
    # at most `frequent` words can have so large a share
    common = words.where(F.col("n_all") * frequent >= n_all).toArrow().combine_chunks()
    usual = joint_scores(most_frequent(counts.where("joint IS NOT NULL"), 2 * frequent), tables, mix).toArrow()
    order = np.argsort(usual.column("joint").to_numpy())
    usual = spark.sparkContext.broadcast(tuple(usual.column(c).to_numpy()[order] for c in ("joint", "bits")))
    shared = spark.sparkContext.broadcast((pa.array(common.column("word").to_pylist(), pa.string()), *(common.column(c).to_numpy() for c in ("n_word", "bits"))))
    numbers = ["n_tokens", "n_known", "n_bytes", "base", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, n, bits = shared.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                t = keyed(part.column("text"), middles)
                at = pc.fill_null(pc.index_in(t.distinct, value_set=known_words), -1).to_numpy(zero_copy_only=False)[t.code]
                row, here = t.row[at >= 0], at[at >= 0]
                add = lambda x: np.bincount(row, x[here], part.num_rows).astype(np.float64)  # noqa: B023, E731
                end = ends[t.of]
                place = np.minimum(np.searchsorted(usual.value[0], t.joints), max(len(usual.value[0]) - 1, 0))
                there = usual.value[0][place] == t.joints if len(usual.value[0]) else np.zeros(len(t.joints), bool)
                cost = np.empty(len(t.joints))
                cost[there], cost[~there] = usual.value[1][place[there]], joint_bits(t.joints[~there], tables.value, mix)
                in_joints = np.bincount(t.joint_row, cost[t.joint], part.num_rows)
                sums = [t.n + 1, add(n > 0).astype(np.int64) + (end[:, 0] > 0), t.size + 1, add(np.log10(n + 0.5)) + np.log10(end[:, 0] + 0.5), add(bits) + end[:, 1] + in_joints]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "id", "held_out")), *map(pa.array, sums), pa.nulls(part.num_rows, pa.string()), pa.nulls(part.num_rows, pa.int64())], ["key", "id", "held_out", *numbers, "word", "times"])
                pairs, times = np.unique(t.row[at < 0].astype(np.int64) * len(t.distinct) + t.code[at < 0], return_counts=True)
                row, code = np.divmod(pairs, max(len(t.distinct), 1))
                rest = [part.column("key").take(pa.array(row)), *(pa.nulls(len(row), part.schema.field(c).type) for c in ("id", "held_out")), *(pa.nulls(len(row), pa.int64() if c.startswith("n_") else pa.float64()) for c in numbers)]
                yield pa.RecordBatch.from_arrays([*rest, t.distinct.take(pa.array(code)), pa.array(times, pa.int64())], ["key", "id", "held_out", *numbers, "word", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), (hashed(F.col(id_col)) % FOLDS == HELD_OUT).alias("held_out"), whole(text).alias("text"))
    split = stored(rows.mapInArrow(run, f"key bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, n_bytes bigint, base double, bits double, word string, times bigint"), "text_words")
    rare = split.where("word IS NOT NULL").select("key", "word", "times").join(words.select("word", "n_word", F.col("bits").alias("word_bits")), "word")
    rare = rare.groupBy("key").agg(F.sum(F.when(F.col("n_word") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n_word") + 0.5)).alias("rare_base"), F.sum(F.col("times") * F.col("word_bits")).alias("rare_bits"))
    or_zero = lambda c: F.coalesce(c, F.lit(0))
    out = split.where("word IS NULL").join(rare, "key", "left").withColumns({
        "n_known": F.col("n_known") + or_zero("rare_known"), "train_tokens": F.lit(n_train).cast("long"),
        "base_score": F.col("base") + or_zero("rare_base") - F.col("n_tokens") * of_all, "bits": F.col("bits") + or_zero("rare_bits"),
    })
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (-F.col("bits") * math.log10(2)).alias("score"), "n_bytes", (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))
