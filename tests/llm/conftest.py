import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Nulls in every column, empty and blank texts, ties, repeated rows and one long text.
AWKWARD = [
    (1, "the cat sat on the mat\nand then it slept", "en", "a", 40),
    (1, "the cat sat on the mat\nand then it slept", "en", "a", 40),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \t\n ", "fr", "b", 4),
    (None, "le chat est sur la table et il dort", "fr", "b", 35),
    (None, None, None, None, None),
    (5, "der hund schläft im garten\nder hund\nder hund", "de", "c", 40),
    (6, "12345 !!! 678", "en", "", 13),
    (7, "word " * 30_000, "en", "a", 150_000),
    (8, "the cat sat on the mat\nand then it slept", None, None, 40),
    (-9, "é" * 50 + " 𝒳 ñandú", "es", "c", 58),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The awkward rows with further columns that carry names the operators use inside."""
    from pyspark.sql import functions as F

    names = ("id", "size", "h", "n", "score", "lang_pred", "lines", "bucket", "shard", "fp", "component", "piece", "length", "axis", "stretch", "taken", "target", "doc", "u", "k", "host", "line", "page")
    return awkward.withColumns({c: F.lit("clash") for c in names})
