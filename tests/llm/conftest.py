import pytest


@pytest.fixture
def odd(spark):
    """Nulls, empty texts, repeated rows, ties, a long text and columns with names that operators use."""
    rows = [
        (None, "null id text here", "en", "a", 1, "x"), (1, None, None, None, None, None), (2, "", "en", "a", 0, "x"), (3, "same text", "en", "b", 9, "x"), (4, "SAME text", "en", "b", 9, "x"),
        (5, "row repeats", "en", "b", 9, "x"), (5, "row repeats", "en", "b", 9, "x"), (6, "a b c " * 20000, "fr", "c", 120000, "x"), (7, "\n\n \n", "de", "c", 4, "x"), (8, "mail me at a@b.co", "de", "c", 4, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string").repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, _id string")


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
