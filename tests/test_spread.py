"""Rows of a task do not grow with the tables, however well their files compress."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stampcard import session
from stampcard.plans import marts

_SET = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
_SET += [f"spark.sql.adaptive.coalescePartitions.{name}" for name in ("initialPartitionNum", "minPartitionNum", "minPartitionSize")]


@pytest.fixture
def restored(spark):
    before = {name: spark.conf.get(name, None) for name in _SET}
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_customers_and_scans_are_dealt_by_rows(spark, restored, monkeypatch, tmp_path):
    folder = str(tmp_path)
    customers = spark.range(0, 950, 1, 1).select(
        F.col("id").alias("c_custkey"), F.lit("AUTOMOBILE").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal"), F.lit(0).alias("c_nationkey")
    )
    customers.write.parquet(f"{folder}/customer.parquet")
    spark.range(0, 5_000, 1, 1).select(F.col("id").alias("l_orderkey")).write.parquet(f"{folder}/lineitem.parquet")
    monkeypatch.setattr(session, "ROWS_PER_SCAN", 1_000)
    for module in (session, marts):
        monkeypatch.setattr(module, "ROWS_PER_PARTITION", 100)
    dealt = marts.Marts(spark, folder).spread()
    rows = [r["count"] for r in dealt.sends().groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) == 10 and max(rows) < 2 * sum(rows) / 10
    plain = marts.Fixtures(spark, folder).sends()
    assert dealt.sends().exceptAll(plain).isEmpty() and dealt.sends().count() == plain.count()
    file_size = spark.read.parquet(f"{folder}/lineitem.parquet").select("_metadata.file_size").first().file_size
    size = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"))
    assert size == pytest.approx(file_size / 5, abs=1) and int(spark.conf.get("spark.sql.files.openCostInBytes").rstrip("b")) == size // 32


def test_few_customers_are_read_as_they_are(spark, restored, tmp_path):
    folder = str(tmp_path)
    spark.range(0, 0, 1, 1).select(F.col("id").alias("l_orderkey")).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(0, 50, 1, 2).select(F.col("id").alias("c_custkey")).write.parquet(f"{folder}/customer.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = marts.Marts(spark, folder).spread().table("customer")
    assert read.count() == 50 and read.inputFiles() and "Exchange" not in read._jdf.queryExecution().toString()
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
