"""A training corpus from `documents`: quality rules, exact dedup, near-duplicate join, mixing, SentencePiece.

Every stage but the last returns the columns it was given, whatever their names;
texts of any length are read whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import exact, mixing, near, pieces, quality
from pointloom.llm.queries import documents, tokenizer
from pointloom.scratch import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the production policy rejects go. Null and empty texts have no words and go; null ids and other nulls don't matter; repeated rows stay or go together."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that agree but for white space stays: the longest, of those the one of the least id, nulls last, and one of repeated rows. Null texts count as empty."""
    return exact.deduplicated(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the least id. Rows with a null id and texts without words stay; repeated rows stay or go together."""
    return near.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once or twice. Null and empty texts go; a null source is one of its own; repeated rows, null ids among them, are decided together."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each document of the mix, repeated rows too. Null texts count as empty, null ids stay null."""
    return pieces.digests(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: None: SQL has neither the hash that draws the mix nor the tokenizer; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
