from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stampcard.operators import encoding, evaluation, isotonic, model
from stampcard.sources import commits

KEYS = ["cust_id"]


def scored(spark, n=3000):
    """Scores with heavy ties and a label that grows with the score."""
    return spark.range(n).select(
        F.col("id").alias("cust_id"),
        F.when(F.col("id") % 3 == 0, 0.25).otherwise((F.col("id") * 37 % 101) / 101.0).alias("p"),
        ((F.col("id") * 13 % 100) < (F.col("id") * 37 % 101)).alias("y"),
    )


def brute_auc(p, y):
    pos, neg = p[y == 1], p[y == 0]
    return sum((a > neg).sum() + 0.5 * (a == neg).sum() for a in pos) / (len(pos) * len(neg))


def brute_average_precision(p, y):
    total, before = 0.0, 0.0
    for cut in sorted(set(p), reverse=True):
        chosen = p >= cut
        recall, precision = y[chosen].sum() / y.sum(), y[chosen].mean()
        total += (recall - before) * precision
        before = recall
    return total


def test_ranking_metrics_match_brute_force(spark):
    df = scored(spark)
    pdf = df.toPandas()
    p, y = pdf["p"].to_numpy(), pdf["y"].to_numpy().astype(int)
    row = evaluation.ranking_metrics(df, "p", "y").first()
    assert row.auc == pytest.approx(brute_auc(p, y), abs=1e-12)
    assert row.average_precision == pytest.approx(brute_average_precision(p, y), abs=1e-12)


def test_brier_and_prior_correction(spark):
    df = spark.createDataFrame([(0.2, True), (0.5, False)], "p DOUBLE, y BOOLEAN")
    assert evaluation.brier(df, "p", "y").first()[0] == pytest.approx((0.64 + 0.25) / 2)
    same = df.select(evaluation.prior_correct(F.col("p"), F.lit(1.0)).alias("q")).collect()
    assert [row.q for row in same] == pytest.approx([0.2, 0.5], abs=1e-8)


def test_rescale_known_rate_else_prior(spark):
    data = [("a", 0.2, True), ("a", 0.4, False), ("b", 0.2, False), ("b", 0.4, False), ("c", 0.9, True), ("c", 0.1, True)]
    df = spark.createDataFrame(data, "camp STRING, p DOUBLE, y BOOLEAN")
    out = {(r.camp, r.p): r.p_5dias for r in evaluation.rescale_to_rate(df, "p", "y", 0.5, ["camp"]).collect()}
    assert out[("a", 0.2)] == pytest.approx(0.2 * 0.5 / 0.3)
    assert out[("c", 0.9)] == 1.0
    assert out[("b", 0.4)] == pytest.approx((0.4 / 0.6 * 0.5) / (1 + 0.4 / 0.6 * 0.5), abs=1e-6)


def pava(x, y):
    """Isotonic fit of equal-weight points, ties in x averaged first."""
    xs = np.unique(x)
    blocks = [[y[x == v].mean(), (x == v).sum(), [v]] for v in xs]
    merged = []
    for block in blocks:
        merged.append(block)
        while len(merged) > 1 and merged[-2][0] >= merged[-1][0]:
            b, a = merged.pop(), merged.pop()
            weight = a[1] + b[1]
            merged.append([(a[0] * a[1] + b[0] * b[1]) / weight, weight, a[2] + b[2]])
    return {v: block[0] for block in merged for v in block[2]}


@pytest.mark.parametrize("fan_in", [2, 16])
def test_isotonic_matches_pool_adjacent_violators(spark, fan_in):
    df = scored(spark, 600).repartition(5)
    pdf = df.toPandas()
    want = pava(pdf["p"].to_numpy(), pdf["y"].to_numpy().astype(float))
    fitted = isotonic.fit(df, "p", "y", fan_in)
    assert fitted.selectExpr("sum(rows) AS n").first().n == 600 and fitted.count() == len(set(want.values()))
    for row in isotonic.apply(fitted, df, "p", "iso").select("p", "iso").distinct().collect():
        assert row.iso == pytest.approx(want[row.p], abs=1e-9)


def test_isotonic_between_and_beyond_steps(spark):
    fitted = spark.createDataFrame([(0.1, 0.2, 5.0, 0.0), (0.3, 0.3, 2.0, 0.4), (0.5, 0.8, 9.0, 0.6), (0.9, 0.9, 1.0, 1.0)], "low DOUBLE, high DOUBLE, rows DOUBLE, value DOUBLE")
    asked = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7, 0.8, 0.85, 0.9, 2.0, None)], "p DOUBLE")
    want = {None: None, **{x: np.interp(x, [0.1, 0.2, 0.3, 0.5, 0.8, 0.9], [0, 0, 0.4, 0.6, 0.6, 1]) for (x,) in asked.where("p IS NOT NULL").collect()}}
    for way in (isotonic._sent, lambda *a: isotonic._joined(*a, buckets=3)):
        got = {r.p: r.v for r in way(fitted, asked, "p", "v").collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(v) if v is not None else got[x] is None for x, v in want.items())
    assert [r.v for r in isotonic.apply(fitted.limit(0), asked, "p", "v").collect()] == [None] * 14


@pytest.mark.parametrize("ratio, negatives", [(2, 200), (50, 900)])
def test_downsample_is_exact_and_repeatable(spark, ratio, negatives):
    df = spark.range(1000).select(F.col("id").alias("cust_id"), (F.col("id") < 100).alias("y"))
    kept = model.downsample(df, "y", KEYS, ratio)
    again = model.downsample(df.repartition(7), "y", KEYS, ratio)
    counts = {row.y: row["count"] for row in kept.groupBy("y").count().collect()}
    assert counts == {True: 100, False: negatives}
    assert sorted(r.cust_id for r in kept.collect()) == sorted(r.cust_id for r in again.collect())
    other = model.downsample(df, "y", KEYS, ratio, seed=7)
    assert (kept.exceptAll(other).count() > 0) == (ratio == 2)


def test_downsample_without_positives(spark):
    df = spark.range(10).select(F.col("id").alias("cust_id"), F.lit(False).alias("y"))
    assert model.downsample(df, "y", KEYS).count() == 0


def test_temporal_split_and_empty_test(spark):
    days = [dt.date(2000, 1, 1 + i) for i in range(10)]
    df = spark.createDataFrame([(f"c{i}", d, i == 9) for i, d in enumerate(days)], "camp STRING, day DATE, y BOOLEAN")
    train, test = model.temporal_split(df, "day", "camp")
    assert (train.count(), test.count()) == (9, 1)
    model.check_split(test, "y")
    with pytest.raises(ValueError):
        model.check_split(train, "y")


def test_unknown_category_is_minus_one(spark):
    seen = spark.createDataFrame([("b",), ("a",), (None,)], "tier STRING")
    new = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "tier STRING")
    codes = encoding.code_table(model.fill_features(seen, [], ["tier"]), ["tier"])
    out = encoding.with_codes(model.fill_features(new, [], ["tier"]), codes, ["tier"]).collect()
    assert {row.tier: row.tier_code for row in out} == {"a": 1.0, "b": 2.0, "z": -1.0, "None": 0.0}


def test_many_labels_are_coded_in_order(spark):
    """200,000 labels of one column and a few of another, over many ranges."""
    df = spark.range(400_000).select(F.concat(F.lit("city "), F.xxhash64(F.col("id") % 200_000).cast("string")).alias("city"), (F.col("id") % 3).cast("string").alias("tier")).repartition(20)
    codes = encoding.code_table(df, ["city", "tier"])
    by = {r.feature: r for r in codes.groupBy("feature").agg(F.count("*").alias("n"), F.countDistinct("code").alias("d"), F.min("code").alias("low"), F.max("code").alias("high")).collect()}
    assert (by["city"].n, by["city"].d, by["city"].low, by["city"].high) == (200_000, 200_000, 0.0, 199_999.0) and by["tier"].n == 3
    rows = [r.label for r in codes.where("feature = 'city'").orderBy("code").select("label").collect()]
    assert rows == sorted(rows)
    assert encoding.with_codes(df, codes, ["city", "tier"]).where("city_code < 0 OR tier_code < 0").count() == 0


def test_absent_inputs_become_zero(spark):
    df = spark.createDataFrame([(1, None, "si")], "age INT, stock_points BIGINT, contact_push_flg STRING")
    out = model.fill_features(model.encode_flags(df, ["contact_push_flg"]), ["age", "stock_points", "tenure_months"], ["tier"]).first()
    assert (out.age, out.stock_points, out.tenure_months, out.tier, out.contact_push_flg) == (1.0, 0.0, 0.0, "0", 1.0)


def test_wide_category_trains_with_fixed_bins(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("cust_id"), (F.col("id") % 5000).cast("string").alias("city"), (F.col("id") % 7 < 3).alias("y"),
        F.lit(dt.date(2000, 5, 1)).alias("fecha_envio"), F.lit("GM").alias("gmgc"), (F.col("id") % 7).alias("age"),
    )
    prepared = model.prepare(rows, [])
    bundle = model.train(prepared, "y", [], trees=3, depth=2)
    assert model.score(bundle, prepared.withColumn("city", F.lit("unseen"))).where("p BETWEEN 0 AND 1").count() == 6000


def test_propensity_fills_absent_inputs(spark):
    data = spark.range(100).select(F.col("id").alias("cust_id"), F.when(F.col("id") % 9 > 0, F.col("id") % 10).alias("frequency_total"), (F.col("id") % 10 > 5).alias("y"))
    fitted = model.train_propensity(data, "y")
    assert model.propensity_scores(fitted, data).where("propensity_score BETWEEN 0 AND 1").count() == 100
    assert model.propensity_scores(None, data).where("propensity_score IS NULL").count() == 100


def test_a_save_that_stops_leaves_the_old_bundle(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select(
        F.col("id").alias("cust_id"), (F.col("id") % 5).cast("string").alias("tier"), (F.col("id") % 7 < 3).alias("y"), F.lit(dt.date(2000, 5, 1)).alias("fecha_envio"), F.lit("GM").alias("gmgc"),
        (F.col("id") % 7).alias("age"),
    )
    prepared, path = model.prepare(rows, []), str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        model.load_bundle(path)
    first, second = (model.train(prepared, "y", [], trees=n, depth=2) for n in (2, 3))
    first.save(path)

    def stopped(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(model.boosting.Booster, "save", stopped)  # after the codes, before the trees
        with pytest.raises(RuntimeError):
            second.save(path)
    assert len(model.load_bundle(path).trees.trees) == 2
    second.save(path)
    assert len(model.load_bundle(path).trees.trees) == 3
    with pytest.raises(RuntimeError):
        commits.commit(spark, path, {"version": "late"}, 1)  # somebody else committed in between
