import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names the operators use."""
    rows = [
        (0, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (2, None, "en", "b"),
        (3, "", None, None),
        (4, " \t\n", "fr", "b"),
        (5, "été à la plage avec les enfants 😀 et puis voilà", "fr", None),
        (6, LONG, "la", "c"),
        (7, "one", "en", "c"),
        (7, "one", "en", "c"),
        (None, "a row without an id", "en", "a"),
        (8, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" at the end', "en", "c"),
        (9, "1234 5678 ... !!!", "en", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(7) for c in ("shard", "size", "row", "fp", "rank", "task", "rest", "block", "label", "score", "h", "t", "i", "n_tokens", "taken", "token", "u", "v", "node")}
    return docs.withColumn("n_chars", F.length("text").cast("long")).withColumns(clash)


@pytest.fixture(scope="session")
def empty(hostile):
    return hostile.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest driver table, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
