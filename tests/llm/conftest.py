import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and blank texts, repeated rows, one text under several ids, one id twice.
ODD = [
    (1, "One two three four five six seven", "en", "a", 3), (1, "One two three four five six seven", "en", "a", 3),
    (2, "ONE TWO THREE FOUR FIVE SIX SEVEN", None, "b", None), (None, "One two three four five six seven", "en", None, 1),
    (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n\t ", "en", "a", 0), (6, "Éa ÉA éa", "fr", "a", 8),
    (None, None, None, None, None), (6, "other words under the same id", "en", "a", 1), (7, "x" * 50_000, "en", "a", 1),
    (8, "word " * 20_000, "en", "c", 1), (9, "a b", "en", "c", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clash(spark, odd):
    """Extra columns whose names the operators might use themselves."""
    names = "fp n_same keep kept digest norm row_no pos line host n fp_ group_size keep_id root class_fp score".split()
    return odd.withColumns({x: F.lit("extra") for x in names})


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
