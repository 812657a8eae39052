import pytest
from pyspark.sql import functions as F

AWKWARD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \t\n ", None, "s", 4),
    (4, "123 !!! 456", "en", None, 11),
    (5, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 62),
    (5, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 62),
    (6, "One TWO three four five six seven eight nine ten eleven twelve", "en", "s", 62),
    (7, "word " * 60_000, "en", "s", 300_000),
    (8, "x" * 200_000, "fr", "t", 200_000),
    (9, "ein zwei\nein zwei\n\nein  ZWEI!\ndrei vier", "de", "t", 40),
    (None, "null id here with some words", "en", "t", 28),
    (10, "émigré naïve Ⅷ ﬁ İstanbul ΣΑΣ 中文 字 👍🏽 <|endoftext|> a<|startoftext|>b it's we'll", "fr", "t", 70),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeats, odd characters, and columns with names that operators use inside."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in ("id", "n", "row", "node", "comp", "a", "b", "sig", "n_words", "kept", "label")})


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
