"""SentencePiece encoding and decoding through tables of distinct marked words.

With a model whose pieces hold the white space marker only in front, no piece
crosses from one marked word (a run of markers and what follows up to the next
marker) into another. Spark splits texts into marked words, each table of
distinct words is segmented once by the library, ids join back by position, and
the library decodes the joined ids.

Defined results: a null or empty text has no ids and decodes to the empty
string; ids and other columns may be null; repeated rows each give a row; an
empty table gives an empty result; clashing columns of the input are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.chunks import Table, flattened, ids_by_row, slices
from pointloom.llm.text import whole

MARK = "▁"  # fixed value: how the library writes a space


@functools.cache
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def words_stand_alone(path: str) -> bool:
    """Whether no piece of the model crosses from one marked word into the next, and the model marks as marked() does."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    return plain and not model.trainer_spec.treat_whitespace_as_suffix and not any(MARK in p.piece.lstrip(MARK) for p in model.pieces)


def marked(text: Column) -> Column:
    """The marked words of a text, in order; those of an empty text are none."""
    full = F.concat(F.lit(MARK), F.translate(text, " ", MARK))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(full, f"(?<=[^{MARK}])(?={MARK})"))


def segment(words: list[str], path: str) -> list[list[int]]:
    """The library puts a marker of its own in front of a text, so the first of each word is left off; a lone marker would be an empty text."""
    sp = processor(path)
    ids = sp.encode([w[1:] for w in words], num_threads=1)
    lone = [sp.piece_to_id(MARK)]
    return [lone if w == MARK else x for w, x in zip(words, ids, strict=True)]


@functools.cache
def table(path: str) -> Table:
    """The worker's table for a model."""
    return Table(lambda words: flattened(segment(words, path)))


def encoded(docs: DataFrame, model: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>, decoded string) for each row."""
    if not words_stand_alone(model):
        raise ValueError("this model has pieces that cross word marks; its words can't be segmented apart")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "words"):
                ids, at = ids_by_row(part.column("words"), table(model))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                texts = [processor(model).decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), marked(whole(text)).alias("words"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), from encoded()."""
    df = encoded(docs, model, text, id_col)
    return df.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
