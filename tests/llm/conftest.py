import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 997}x{i}" for i in range(20_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n ", "de", None, 3), (4, "one two", "en", "", 7),
        (4, "one two", "en", "", 7), (5, "one two", "en", "b", None), (None, "one two", "fr", "b", 7), (6, long, "en", "b", 1),
        (7, long, "en", "c", 1), (8, long + " end", "en", "c", 1), (9, "12345 678 !!", "en", "c", 3), (10, "é ü ß <|endoftext|>  x", "de", None, 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for c in ("k", "name", "size", "bucket", "node", "component", "kept", "row", "score", "block"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
