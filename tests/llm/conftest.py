import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, row int, node string, copy int, _row int, Text2 string"


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls anywhere, empty and long texts, ties, repeated rows, and columns named as operators' own."""
    rest = (None, None, None, 0.5, "x", 1, "n", 2, 3, "t")
    texts = [(1, None), (2, ""), (None, "no id here"), (3, "one"), (3, "one"), (3, "two words"), (4, "é中 \x00 <|endoftext|>\n\n  x " * 40), (5, "long text of words and words " * 4000), (6, "long text of words and words " * 4000), (7, " \n\t "), (8, "a b c d e f g"), (9, "a b c d e f g"), (None, None)]
    return spark.createDataFrame([(i, t, *rest) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
