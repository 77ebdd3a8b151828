"""Texts reach Python in batches of bounded bytes."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stampcard.llm import common

_NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    before = spark.conf.get(_NAME, None)
    spark.conf.unset(_NAME)
    yield
    spark.conf.unset(_NAME) if before is None else spark.conf.set(_NAME, before)


def test_stages_bound_their_batches(spark, unset, monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 20)
    docs = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1_000).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    corpus_pipeline.token_ids(spark, docs, "")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 9_000_000 and max(found) < 2 << 20


def test_a_setting_of_the_session_stays(spark, unset):
    spark.conf.set(_NAME, "12345678")
    common.bound_batches(spark)
    assert spark.conf.get(_NAME).startswith("12345678")
