from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stampcard.operators import ranking


def skewed(spark, n=6000):
    """A third of the rows share one value, another third a second one."""
    return spark.range(n).select(
        ((F.col("id") * 7919) % n).alias("cust_id"),
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 50).otherwise(F.col("id") % 97).cast("bigint").alias("v"),
    )


@pytest.mark.parametrize("buckets", [None, 7])
def test_rank_is_exact_under_heavy_ties(spark, buckets):
    df = skewed(spark)
    got = ranking.distributed_rank(df, "v", "cust_id", buckets=buckets).toPandas().sort_values("rn")
    want = df.toPandas().sort_values(["v", "cust_id"]).reset_index(drop=True)
    assert got["rn"].tolist() == list(range(1, len(want) + 1))
    assert got["cust_id"].tolist() == want["cust_id"].tolist()


def test_heavy_values_are_split(spark):
    df = skewed(spark)
    n, (cuts,) = ranking._plan_cuts(df, ["v"], "cust_id", 50)
    sizes = cuts.add_bucket(df, "v", "cust_id", "b").groupBy("b").count().toPandas()["count"]
    assert sizes.max() < n / 10
    assert len(sizes) < 50 * 20


def test_heavy_values_tied_to_the_key_are_split(spark):
    """The heavy value sits in one range of keys."""
    df = spark.range(9000).select(F.col("id").alias("cust_id"), F.when(F.col("id") > 6000, 1).otherwise(F.col("id") % 11).cast("bigint").alias("v"))
    n, (cuts,) = ranking._plan_cuts(df, ["v"], "cust_id", 100)
    sizes = cuts.add_bucket(df, "v", "cust_id", "b").groupBy("b").count().toPandas()["count"]
    assert sizes.max() < n / 10


def closed_form(n, rank):
    return 3 if n == 1 else max(1, -(-5 * (rank - 1) // (n - 1)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 11, 23])
def test_quintiles_follow_the_rank(spark, n):
    df = spark.createDataFrame([(i, (i * 5) % 3) for i in range(n)], "cust_id BIGINT, v BIGINT")
    out = ranking.quintiles(df, {"up": ("v", True), "down": ("v", False)}, "cust_id").toPandas()
    out = out.sort_values(["v", "cust_id"]).reset_index(drop=True)
    up = [closed_form(n, i + 1) for i in range(n)]
    assert out["up"].tolist() == up
    assert out["down"].tolist() == ([3] if n == 1 else [6 - k for k in up])


def test_quintiles_match_pandas(spark):
    df = skewed(spark, 3001)
    pdf = df.toPandas().sort_values("cust_id").reset_index(drop=True)
    want = pd.qcut(pdf["v"].rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    got = ranking.quintiles(df, {"s": ("v", True)}, "cust_id").toPandas().sort_values("cust_id")
    assert got["s"].tolist() == want.tolist()


def test_deciles_match_pandas_with_merged_edges(spark):
    df = skewed(spark).withColumn("x", F.col("v") / 7.0)
    pdf = df.toPandas().sort_values("cust_id").reset_index(drop=True)
    want = pd.qcut(pdf["x"], 10, labels=False, duplicates="drop")
    got = ranking.quantile_bins(df, "x", "cust_id").toPandas().sort_values("cust_id")
    assert got["decile"].tolist() == want.tolist()


def test_median_matches_pandas_and_skips_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i * i % 37)) for i in range(101)], "cust_id BIGINT, x DOUBLE")
    assert ranking.exact_quantile(df, "x", "cust_id", [0.5]) == [df.toPandas()["x"].median()]
    assert ranking.exact_quantile(df.where("false"), "x", "cust_id", [0.5]) == []


def test_order_statistics_of_hashes(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"), F.col("id").alias("t"))
    values = sorted(row.h for row in df.collect())
    hits = ranking.order_statistics(df, "h", "t", [1, 2500, 5000])
    assert [hit.value for hit in hits] == [values[0], values[2499], values[4999]]


def test_running_totals(spark):
    df = spark.createDataFrame([(i / 3.0, i % 4, 1) for i in range(700)], "score DOUBLE, pos BIGINT, neg BIGINT")
    got = ranking.running_totals(df, "score", ["pos", "neg"]).toPandas().sort_values("score").reset_index(drop=True)
    assert got["pos_upto"].tolist() == got["pos"].cumsum().tolist()
    assert got["neg_upto"].tolist() == got["neg"].cumsum().tolist()


def test_no_single_partition_in_rank_and_scores(spark):
    df = skewed(spark)
    ranked = ranking.distributed_rank(df, "v", "cust_id")
    scored = ranking.quintiles(df, {"s": ("v", True)}, "cust_id")
    for frame in (ranked, scored):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    assert "Exchange" not in plan


def test_infinite_values_rank_at_the_ends(spark):
    df = spark.createDataFrame([(i, float("inf") if i % 2 else float(i)) for i in range(40)], "k BIGINT, v DOUBLE")
    got = ranking.distributed_rank(df, "v", "k").orderBy("rn").toPandas()
    assert got["rn"].tolist() == list(range(1, 41))
    assert got["k"].tolist() == [*range(0, 40, 2), *range(1, 40, 2)]


def test_nulls_and_nan_have_no_rank(spark):
    data = [(1, 5.0), (2, None), (3, 1.0), (4, float("nan")), (5, None), (6, 3.0)]
    df = spark.createDataFrame(data, "id BIGINT, v DOUBLE")
    ranked = {r.id: r.rn for r in ranking.distributed_rank(df, "v", "id").collect()}
    assert ranked == {1: 3, 2: None, 3: 1, 4: None, 5: None, 6: 2}


def test_buckets_follow_the_rows(spark, monkeypatch):
    """A million rows, a thousand wanted in a bucket, a tenth of them on one value: no bucket holds much more."""
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 1000)
    df = spark.range(1_000_000).select(F.col("id").alias("cust_id"), F.when(F.col("id") % 10 == 0, 0.5).otherwise(F.rand(7)).alias("v"))
    n, (cuts,) = ranking._plan_cuts(df, ["v"], "cust_id", None)
    sizes = cuts.add_bucket(df, "v", "cust_id", "b").groupBy("b").count()
    assert n == 1_000_000 and sizes.agg(F.max("count")).first()[0] <= 2500
    ranked = ranking.distributed_rank(df, "v", "cust_id")
    assert ranked.agg(F.count_distinct("rn"), F.max("rn")).first() == (n, n)
