import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size int, n_words string"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (0, "alpha beta  gamma\tdelta\nepsilon zeta", "en", "b", 3, True, 1, "x"),
        (1, "alpha beta gamma delta epsilon zeta", None, "a", None, None, None, None),
        (2, "alphabetagammadeltaepsilonzeta", "en", None, 3, False, 2, "y"),
        (3, None, "en", "a", 3, False, 2, "y"),
        (4, "", "en", None, 3, False, 2, "y"),
        (5, " \n\t ", None, None, None, None, None, None),
        (None, "text without an id", "en", "c", 1, True, 1, "z"),
        (None, "text without an id", "en", "c", 1, True, 1, "z"),
        (6, long, "en", "c", 1, True, 1, "z"),
        (7, long, "en", "c", 1, True, 1, "z"),
        (8, "one two three four five six seven\none two three four five six seven\n\nlast", "fr", "c", 1, True, 1, "z"),
        (8, "one two three four five six seven\none two three four five six seven\n\nlast", "fr", "c", 1, True, 1, "z"),
        (9, "é́ß日本語▁mark  ı İ   <0x0A> <unk> <|endoftext|> ### $$$", "fr", "é", 1, True, 1, "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
