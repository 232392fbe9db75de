import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "many words of one very long text that goes on " * 4000 + "end"
#: Nulls, empty and long texts, ties, repeated rows and a null id.
ODD = [
    (1, "A first line of text\nshared line of words\n\nlast", "en", "a", 1),
    (2, "shared line of words  \nOther text stands here", None, None, None),
    (2, "SHARED line of words\nanother row of the same id", "en", "b", 2),
    (3, None, "en", "a", 3),
    (4, "", "en", "a", 4),
    (5, "  \t \n\n", "en", "c", 5),
    (None, "shared line of words\nwithout an id", "en", "a", 6),
    (None, None, None, None, None),
    (6, LONG, "en", "a", 7),
    (7, LONG, "en", "b", 8),
    (8, "same row", "en", "b", 9),
    (8, "same row", "en", "b", 9),
    (9, "é ﬁ ① ▁ 漢字́ \U0001f44d\r\nx\x00y \x1c\x85", "fr", "Ω", 10),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(spark):
    """Columns named like those that operators add, with a type of their own."""
    names = "doc tag fp key uid keep counts lines copies size ids decoded shard runs raw root node a b part part_ law digest license".split()
    return spark.createDataFrame(ODD, SCHEMA).select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
