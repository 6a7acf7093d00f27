import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("tag", T.StringType()), ("row", T.StringType()), ("key", T.StringType()), ("site", T.StringType()), ("node", T.LongType()))])


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names an operator might use itself."""

    def make(rows, sources=None):
        full = [(i, t, "en", (sources or {}).get(i, "s"), None if t is None else len(t), "x", "y", "z", "w", 7) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "a row without an id"), (5, "same row"), (5, "same row"), (6, "long " * 30000), (7, "ünïcode 日本語 😀 words")]


@pytest.fixture(scope="session")
def edges(frame):
    return frame(EDGES)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
