import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", keep_id long, digest string, id string, key long, run int, component string, start long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, a repeated row, and columns with names used inside."""
    long_text = "\n".join("word%d " % (i % 97) * 40 for i in range(400))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog"),
        (2, "THE QUICK brown fox jumps over the lazy dog"),
        (3, None),
        (4, ""),
        (5, "   \n\t "),
        (6, long_text),
        (7, long_text),
        (8, "É is not é"),
        (8, "É is not é"),
        (9, "12 34 !!"),
        (10, "one two three"),
        (None, "a text without an id"),
    ]
    rows = [(i, t, None if i in (1, None) else "en", None, None, None, "x", None, 5, None, "c", 0) for i, t in texts]
    return spark.createDataFrame(rows, EXTRA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
