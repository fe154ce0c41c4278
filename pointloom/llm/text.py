"""Column expressions on words that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word of the contracts.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def whole(text: Column | str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words_of_trimmed(text: Column) -> Column:
    """The words of a text that neither begins nor ends with white space."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, SPACE + "+"))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)
