"""End-to-end jobs: rebuild the metrics cube, extract the report datasets, train the model."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from stampcard.operators import evaluation, model
from stampcard.operators.attribution import attribute_redemptions, attribute_redemptions_horizon
from stampcard.operators.features import customer_features, spend_column
from stampcard.operators.metrics import campaign_redemption_metrics, rfm_campaigns, score_attributed
from stampcard.operators.rfm import NO_SCORE, rfm_table
from stampcard.session import materialize
from stampcard.sources.sinks import write_individual, write_metrics, write_parquet


@dataclass
class Entities:
    """Input entities of the jobs; see ``stampcard.schemas`` for their columns."""

    clients: DataFrame
    trx: DataFrame
    redemptions: DataFrame
    sends: DataFrame
    mail: DataFrame
    jobs: DataFrame
    funnel: DataFrame


def rebuild_metrics(data: Entities, start: dt.date, end: dt.date, path: str, backfill: bool = False) -> None:
    """Metrics cube of the sends in [start, end]; a backfill replaces these days only, also those that have no rows any more."""
    cube = campaign_redemption_metrics(data.sends, data.redemptions, data.funnel, data.mail, data.jobs, start, end)
    write_metrics(cube, path, (start, end) if backfill else None)


def build_rfm(data: Entities, t0: dt.date, channels: list[str], score: DataFrame | None = None) -> DataFrame:
    """Scored customers. Features are stored once, as ranking reads them several times.

    ``score`` holds ``cust_id, propensity_score`` from an earlier model; without it the score is null.
    """
    features = materialize(customer_features(data.clients, data.trx, data.redemptions, t0, channels), "features")
    scored = rfm_table(features, [spend_column(name) for name in channels])
    if score is None:
        return scored.withColumn("propensity_score", F.lit(None).cast("double"))
    return scored.join(score, "cust_id", "left")


def extract(data: Entities, start: dt.date, end: dt.date, t0: dt.date, channels: list[str], root: str,
            score: DataFrame | None = None) -> None:
    """Store the scored customers, the customer-level outcomes and the segment cube under ``root``."""
    spark = data.clients.sparkSession
    write_parquet(build_rfm(data, t0, channels, score), f"{root}/rfm_all_clients")
    rfm = spark.read.parquet(f"{root}/rfm_all_clients")
    attributed = materialize(score_attributed(attribute_redemptions(data.sends, data.redemptions, start, end), rfm, NO_SCORE),
                             "attributed")
    write_individual(attributed, f"{root}/rfm_campaigns_individual")
    write_parquet(rfm_campaigns(attributed), f"{root}/rfm_campaigns")


def train_campaign_model(sends: DataFrame, redemptions: DataFrame, rfm: DataFrame, start: dt.date, end: dt.date,
                         spend_columns: list[str], path: str | None = None, trees: int = model.TREES, depth: int = model.DEPTH):
    """Sample, join features, split by time, fit, calibrate and evaluate.

    Returns the bundle and a one-row frame of metrics; with ``path`` both are saved. The sample is drawn before
    the feature join and stored, as every later step reads it again.
    """
    label, keys = "canjeo_5d", ["fecha_envio", "nombre_campanha", "gmgc", "cust_id"]
    outcomes = materialize(attribute_redemptions_horizon(sends, redemptions, start, end), "outcomes")
    real_rate = outcomes.agg(F.avg(F.col(label).cast("int")).alias("rate")).first().rate
    sample = model.downsample(outcomes, label, keys).join(rfm, "cust_id")
    rows = materialize(model.prepare(sample, spend_columns), "training-rows")
    train, test = model.temporal_split(rows, "fecha_envio", "nombre_campanha")
    model.check_split(test, label)
    fitted = model.train(train, label, spend_columns, trees, depth)

    kept = [*keys, label]
    scored = materialize(model.score(fitted, test, keep=kept), "test-scores")
    scored_train = model.score(fitted, train, keep=kept)
    fitted.calibrator = model.isotonic(scored, "p", label)
    ratio = model.sample_ratio(fitted.calibrator, scored, "p", real_rate)
    calibrated = materialize(model.calibrate(fitted.calibrator, scored, "p", real_rate), "calibrated")
    on_test = evaluation.ranking_metrics(scored, "p", label).select("auc", "average_precision")
    on_train = evaluation.ranking_metrics(scored_train, "p", label)
    deciles = evaluation.decile_table(calibrated.withColumn("_tie", F.xxhash64(*keys)), "p", "cal", label, "_tie")
    metrics = on_test.withColumns(
        {
            "auc_train": on_train.select("auc").scalar(),
            "brier_cal": evaluation.brier(calibrated, "cal", label).scalar(),
            "lift_top_decile": evaluation.top_decile_lift(deciles).scalar(),
            "base_rate_real": F.lit(real_rate),
            "prior_ratio": F.lit(ratio),
            "n_train": train.agg(F.count(F.lit(1))).scalar(),
            "n_test": test.agg(F.count(F.lit(1))).scalar(),
            "n_campaigns": outcomes.agg(F.countDistinct("nombre_campanha")).scalar(),
            "n_features": F.lit(len(model.feature_names(spend_columns))),
            "start_date": F.lit(start),
            "end_date": F.lit(end),
            "cutoff_date": model.temporal_cutoff(rows, "fecha_envio", "nombre_campanha").scalar(),
        }
    ).withColumn("overfit_gap", F.col("auc_train") - F.col("auc"))
    metrics = metrics.withColumn("overfit", evaluation.overfit_check(F.col("auc_train"), F.col("auc")))
    metrics = materialize(metrics, "model-metrics")
    fitted.facts |= {"prior_ratio": ratio, "base_rate_real": real_rate, "metrics": metrics.first().asDict(), "trained_at": dt.datetime.now().isoformat()}
    if path:
        fitted.save(path)
        write_parquet(metrics, f"{path}/metrics")
    return fitted, metrics
