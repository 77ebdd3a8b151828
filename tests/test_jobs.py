"""The jobs end to end on the smallest tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window, functions as F

from stampcard.fixtures import CHANNELS, END, SPEND, START, T0
from stampcard.operators import isotonic, model
from stampcard.plans import jobs
from stampcard.plans.marts import Marts
from stampcard.schemas import schema
from stampcard.session import materialize, shared_dir
from stampcard.sources import scans, sinks
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def marts(spark):
    return Marts(spark, SF_SMALL)


def content(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_rebuild_and_backfill(spark, marts, tmp_path):
    path = str(tmp_path / "metrics")
    data = marts.entities()
    jobs.rebuild_metrics(data, START, END, path)
    stored = scans.read_dates(spark, path, schema("metrics"))
    assert content(stored) == content(marts.metrics())
    one = scans.read_dates(spark, path, schema("metrics"), dt.date(2000, 3, 5), dt.date(2000, 3, 5))
    assert one.count() > 0 and all("FECHA_ENVIO=2000-03-05" in name for name in one.inputFiles())
    jobs.rebuild_metrics(data, dt.date(2000, 9, 1), END, path, backfill=True)
    again = scans.read_dates(spark, path, schema("metrics"))
    early = "FECHA_ENVIO < DATE '2000-09-01'"
    assert content(again.where(early)) == content(marts.metrics().where(early))
    assert again.select("FECHA_ENVIO").distinct().count() == 12


def test_extract_writes_three_datasets(spark, marts, tmp_path):
    root = str(tmp_path)
    jobs.extract(marts.entities(), START, END, T0, CHANNELS, root)
    stored = spark.read.parquet(f"{root}/rfm_all_clients")
    assert stored.count() == 150 and stored.where("propensity_score IS NOT NULL").count() == 0
    assert content(stored.select("cust_id", "rfm_segment")) == content(marts.rfm().select("cust_id", "rfm_segment"))
    assert content(spark.read.parquet(f"{root}/rfm_campaigns")) == content(marts.rfm_cube())
    one = scans.read_campaign(spark, f"{root}/rfm_campaigns_individual", "Camp Nro 3_05032000")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(NOMBRE_CAMPANHA" in plan
    assert dict(one.dtypes)["propensity_score"] == "float" and one.count() > 0


def test_csv_round_trip(spark, marts, tmp_path):
    sinks.write_csv(marts.rfm_cube(), str(tmp_path / "csv"))
    back = spark.read.schema(marts.rfm_cube().schema).option("header", True).csv(str(tmp_path / "csv"))
    assert content(back) == content(marts.rfm_cube())


def _test_scores(spark, bundle, marts):
    """Scores of the sampled rows after the cutoff, as in the training."""
    keys = ["fecha_envio", "nombre_campanha", "gmgc", "cust_id"]
    sample = model.downsample(marts.outcomes(), "canjeo_5d", keys).join(marts.rfm(), "cust_id")
    return model.score(bundle, model.prepare(sample, SPEND).where(F.col("fecha_envio") > dt.date(2000, 10, 5)))


def test_train_saves_model_and_metrics(spark, tmp_path):
    marts = Marts(spark, SF_SMALL.replace("sf0.001", "sf0.01"))
    path = str(tmp_path / "bundle")
    fitted, metrics = jobs.train_campaign_model(marts.sends(), marts.redemptions(), marts.rfm(), START, END, SPEND, path, trees=2, depth=3)
    row = metrics.first()
    assert 0 <= row.auc <= 1 and 0 <= row.average_precision <= 1 and row.n_test > 0
    assert row.cutoff_date == dt.date(2000, 10, 5)
    stored = model.load_bundle(path)
    assert len(stored.trees.trees) == len(fitted.trees.trees) == 2 and content(stored.calibrator) == content(fitted.calibrator)
    assert stored.facts["prior_ratio"] == fitted.facts["prior_ratio"] == row.prior_ratio and stored.facts["trained_at"]
    mean = isotonic.apply(fitted.calibrator, _test_scores(spark, fitted, marts), "p", "iso").agg(F.avg("iso")).first()[0]
    odds = lambda x: x / (1 - x)
    assert row.prior_ratio == pytest.approx(odds(row.base_rate_real) / odds(mean), rel=1e-6)
    planned = model.predict_audience(stored, marts.rfm().limit(20), dt.date(2001, 1, 15))
    assert planned.count() == 20 and planned.where("p_5dias < 0 OR p_5dias > 1").count() == 0
    assert spark.read.parquet(f"{path}/metrics").count() == 1


def test_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_materialize_keeps_schema_and_column_order(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "x INT, part STRING, y DOUBLE")
    stored = materialize(df, "probe", ["part"])
    assert stored.dtypes == df.dtypes and [tuple(r) for r in stored.collect()] == [(1, "a", 2.0)]


def test_a_range_of_days_is_replaced_whole(spark, tmp_path, monkeypatch):
    """Days of the range without rows go, other days stay, and a write that stops changes nothing."""
    from stampcard.sources import commits, scans, sinks

    day = lambda k: dt.date(2000, 5, k)
    frame = lambda rows: spark.createDataFrame(rows, "x INT, day DATE")
    path = str(tmp_path / "cube")
    read = lambda *days: sorted((r.x, r.day) for r in scans.read_dates(spark, path, frame([]).schema, *days).collect())
    assert read() == []
    sinks.write_dates(frame([(k, day(k)) for k in range(1, 8)]), path, "day")
    sinks.write_dates(frame([(30, day(3)), (31, day(3)), (50, day(5))]), path, "day", (day(3), day(5)))
    wanted = [(1, day(1)), (2, day(2)), (6, day(6)), (7, day(7)), (30, day(3)), (31, day(3)), (50, day(5))]
    assert read() == wanted and read(day(3), day(6)) == [(6, day(6)), (30, day(3)), (31, day(3)), (50, day(5))]
    with monkeypatch.context() as broken:
        broken.setattr(commits, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sinks.write_dates(frame([(99, day(1))]), path, "day", (day(1), day(7)))
    assert read() == wanted
    with pytest.raises(ValueError):
        sinks.write_dates(frame([(9, day(9))]), path, "day", (day(1), day(7)))
    sinks.write_dates(frame([]), path, "day", (day(1), day(6)))
    assert read() == [(7, day(7))]


def test_rows_of_a_task_do_not_grow_with_their_compression(spark):
    """A million rows that compress to a few bytes each are not merged into a few tasks."""
    from stampcard.session import ROWS_PER_PARTITION, spread_by_rows

    names = [f"spark.sql.adaptive.coalescePartitions.{x}" for x in ("initialPartitionNum", "minPartitionNum", "minPartitionSize")]
    try:
        spread_by_rows(spark, 2_000_000)
        days = spark.range(2_000_000).select((F.col("id") % 40_000).alias("cust_id"), F.lit("the same state on each day").alias("state"))
        counted = days.withColumn("n", F.count("state").over(Window.partitionBy("cust_id"))).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
        most, total = counted.agg(F.max("rows"), F.sum("n")).first()
        assert total == 2_000_000 * 50 and most <= 1.5 * ROWS_PER_PARTITION
    finally:
        for name in names:
            spark.conf.unset(name)
