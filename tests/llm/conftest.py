from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def docs(spark):
    """Build ``documents`` from (doc_id, text) pairs."""

    def make(rows, partitions: int = 3):
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS).repartition(partitions)

    return make


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One two three four five six."), (4, "One two three four five six."), (None, "id is null here, text is not"),
    (5, "x" * 70_000), (6, "the same word " * 9_000), (7, "Ünïcödé 漢字 🙂 \x01 \x1c\x85 a b  c\r\n\r\nd"), (8, "line\nline\nline\nother"), (None, None),
]


@pytest.fixture(scope="session")
def odd_rows():
    return list(ODD)
