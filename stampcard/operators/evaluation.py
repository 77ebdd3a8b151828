"""Score calibration and ranking metrics, distributed: per-score counts and running totals, no global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stampcard.functions.ratios import band_gap, clip01
from stampcard.operators.ranking import quantile_bins, running_totals

# Guard of the odds and the lowest campaign rate that counts as observed.
EPS = 1e-9
MIN_OBSERVED_RATE = 0.001
OVERFIT_GAP = 0.05


def prior_correct(p: Column, ratio: Column) -> Column:
    """Move a probability from the sampled to the real base rate through its odds."""
    moved = p / (F.lit(1.0) - p + F.lit(EPS)) * ratio
    return moved / (F.lit(1.0) + moved)


def prior_ratio(base_rate: Column, sample_rate: Column) -> Column:
    """Odds of the real base rate over odds of the mean sampled score."""
    one, eps = F.lit(1.0), F.lit(EPS)
    return (base_rate / (one - base_rate + eps)) / (sample_rate / (one - sample_rate + eps))


def rescale_to_rate(df: DataFrame, p: str, observed: str, ratio: float, keys: list[str], out: str = "p_5dias") -> DataFrame:
    """Scale scores of each group to its observed rate; without one, correct by the prior.

    The group means are one row per campaign, stored, so that their size decides how they are joined back to the scores.
    """
    from stampcard.session import materialize

    means = materialize(df.groupBy(*keys).agg(
        F.avg(F.col(observed).cast("int")).alias("_rate"), F.avg(p).alias("_mean")
    ), "campaign-means")
    joined = df.join(means, keys)
    scaled = clip01(F.col(p) * F.try_divide(F.col("_rate"), F.col("_mean")))
    known = (F.col("_rate") > MIN_OBSERVED_RATE) & (F.col("_mean") > 0)
    value = F.when(known, scaled).otherwise(prior_correct(F.col(p), F.lit(ratio)))
    return joined.withColumn(out, value).drop("_rate", "_mean")


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score with its positives and negatives."""
    positive = F.col(label).cast("int")
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum(positive).cast("bigint").alias("pos"), F.sum(1 - positive).cast("bigint").alias("neg")
    )


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision (sum of recall steps) in one row."""
    from stampcard.session import materialize

    counts = materialize(score_counts(df, score, label), "score-counts")
    totals = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    upto = running_totals(counts, "score", ["pos", "neg"]).withColumns({"p": totals["p"], "n": totals["n"]})
    below = F.col("neg_upto") - F.col("neg") / 2
    hits = F.col("p") - F.col("pos_upto") + F.col("pos")
    alarms = F.col("n") - F.col("neg_upto") + F.col("neg")
    return upto.agg(
        F.try_divide(F.sum(F.col("pos") * below), F.max("p") * F.max("n")).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * hits / (hits + alarms)), F.max("p")).alias("average_precision"),
    )


def brier(df: DataFrame, p: str, label: str) -> DataFrame:
    gap = F.col(p) - F.col(label).cast("int")
    return df.agg(F.avg(gap * gap).alias("brier"))


def decile_table(df: DataFrame, score: str, calibrated: str, label: str, tie: str) -> DataFrame:
    """Rows, mean prediction, observed rate, gap and lift per score decile."""
    binned = quantile_bins(df, score, tie, 10, "decile")
    positive = F.col(label).cast("int")
    table = binned.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(calibrated).alias("predicted"), F.avg(positive).alias("observed"),
        F.sum(positive).alias("_pos"),
    )
    base = table.agg(F.try_divide(F.sum("_pos"), F.sum("n"))).scalar()
    gap = (F.col("predicted") - F.col("observed")) * 100
    return table.select(
        "decile", "n",
        F.round("predicted", 6).alias("predicted"),
        F.round("observed", 6).alias("observed"),
        F.round(gap, 4).alias("gap_pp"),
        band_gap(gap).alias("band"),
        F.round(F.try_divide(F.col("observed"), base), 6).alias("lift"),
    ).orderBy("decile")


def top_decile_lift(table: DataFrame) -> DataFrame:
    return table.agg(F.max_by("lift", "decile").alias("top_lift"))


def overfit_check(train_auc: Column, test_auc: Column) -> Column:
    return F.when(train_auc - test_auc > OVERFIT_GAP, "possible overfit").otherwise("ok")
