import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with the other columns null."""

    def make(*rows):
        return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and long texts, repeated rows and ids."""
    long = " ".join(f"w{i % 977}x{i // 7}" for i in range(40_000))
    return make_docs(
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, long), (6, long), (7, "one"), (None, "null id " * 30), (None, None), (8, "wher " * 300), (9, "é" * 500), (-3, long[:5000])
    )
