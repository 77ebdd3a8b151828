"""Training, scoring and storing of the short-horizon redemption model."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stampcard.functions.dates import send_calendar
from stampcard.functions.text import MODEL_TRUE, truthy
from stampcard.operators import boosting, encoding
from stampcard.operators import isotonic as steps
from stampcard.operators.evaluation import prior_correct, prior_ratio, rescale_to_rate
from stampcard.operators.ranking import order_statistics
from stampcard.session import materialize
from stampcard.sources import commits

# Model inputs by kind.
CATEGORICAL = ["tier", "gender", "city", "rfm_segment", "dominant_retailer", "funnel_state_at_t0"]
FLAGS = [
    "cust_active_deb_flg", "cust_active_cmr_flg", "contact_email_flg", "contact_phone_flg", "contact_push_flg",
    "cust_active_omp_flg",
]
PROPENSITY = [
    "frequency_monthly_avg", "monetary_monthly_avg", "redeem_rate", "retailer_entropy", "pct_redeem_digital",
    "earn_velocity_90", "days_since_last_activity", "points_pressure", "stock_points_at_t0", "redeem_count_pre",
    "frequency_total", "monetary_total", "tenure_months",
]
NUMERIC = [
    "age", "stock_points", "exp_points_current", "exp_points_next", "recency_days", "r_score", "f_score", "m_score",
    "propensity_score", "earn_velocity_30", "pct_cmr_payments", "pct_debit_payments", "avg_redeem_points",
    "pct_redeem_catalogo", "pct_redeem_giftcard", "days_since_last_redeem",
]
CONTEXT = ["mes_envio", "dia_semana_envio", "es_gm", "es_cyber_month", "es_diciembre"]
MISSING_CATEGORY = "None"
SEED = 42
# Size, learning rate, samples and penalties of the trees.
TREES, DEPTH = 500, 6
BOOSTING = boosting.Settings(trees=TREES, depth=DEPTH, rate=0.03, rows=0.9, columns=0.6, child_weight=5.0, gamma=0.1, l1=0.5, l2=0.01, seed=SEED)
#: Training rows wanted in a task.
ROWS_PER_TASK = 50_000


@dataclass
class Bundle:
    """All that scoring needs: codes of the categories, trees, calibration steps, and facts of the training.

    ``facts`` holds prior ratio, base rate, importances, metrics, configuration and time; it is stored as JSON.
    """

    codes: DataFrame
    trees: boosting.Booster
    spend_columns: list[str]
    calibrator: DataFrame | None = None
    facts: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        """Write all parts as a new version, then name it the current one. Whoever loads meanwhile, or after a failure, gets the version before."""
        spark = self.codes.sparkSession
        after, _ = commits.latest(spark, path)
        version = commits.new_version()
        self._write(spark, f"{path}/{version}")
        commits.commit(spark, path, {"version": version}, after)

    def _write(self, spark: SparkSession, folder: str) -> None:
        self.codes.write.parquet(f"{folder}/codes")
        self.trees.save(spark, f"{folder}/boosting")
        if self.calibrator is not None:
            self.calibrator.write.parquet(f"{folder}/calibrator")
        stored = json.dumps({**self.facts, "spend_columns": self.spend_columns, "calibrated": self.calibrator is not None}, default=str)
        spark.createDataFrame([(stored,)], "facts STRING").coalesce(1).write.parquet(f"{folder}/facts")


def load_bundle(path: str) -> Bundle:
    spark = SparkSession.active()
    _, current = commits.latest(spark, path)
    if not current:
        raise FileNotFoundError(f"{path} holds no finished model")
    folder = f"{path}/{current['version']}"
    facts = json.loads(spark.read.parquet(f"{folder}/facts").first().facts)
    calibrator = spark.read.parquet(f"{folder}/calibrator") if facts.pop("calibrated") else None
    return Bundle(spark.read.parquet(f"{folder}/codes"), boosting.Booster.load(spark, f"{folder}/boosting"), facts.pop("spend_columns"), calibrator, facts)


def numeric_inputs(spend_columns: list[str]) -> list[str]:
    return [*PROPENSITY, *NUMERIC, *spend_columns]


def downsample(df: DataFrame, label: str, keys: list[str], ratio: int = 5, seed: int = SEED) -> DataFrame:
    """All positives and exactly ``min(ratio * positives, negatives)`` negatives.

    Negatives are ordered by a seeded hash of their key; the hash at the last kept position is the cut, so the
    sample is exact and repeatable and nothing is sorted as a whole or shuffled.
    """
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(seed), *keys)).withColumn("_tie", F.xxhash64(F.lit(~seed), *keys))
    counts = df.agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")).first()
    keep = min(ratio * counts.pos, counts.neg)
    if keep == counts.neg:
        return df
    if keep == 0:
        return df.where(F.col(label))
    (cut,) = order_statistics(hashed.where(~F.col(label)), "_hash", "_tie", [keep])
    below = (F.col("_hash") < cut.value) | ((F.col("_hash") == cut.value) & (F.col("_tie") <= cut.tie))
    return hashed.where(F.col(label) | (~F.col(label) & below)).drop("_hash", "_tie")


def union_of_samples(df: DataFrame, label: str, keys: list[str], ratio: int = 5, seed: int = SEED) -> DataFrame:
    """The positives and the drawn negatives as two samples, put together by column name."""
    negatives = downsample(df, label, keys, ratio, seed).where(~F.col(label))
    return df.where(F.col(label)).unionByName(negatives)


def campaign_context(df: DataFrame, send_date: str = "fecha_envio", group: str = "gmgc") -> DataFrame:
    treated = F.coalesce(F.col(group) == "GM", F.lit(False)).cast("double")
    return df.withColumns({**send_calendar(F.col(send_date)), "es_gm": treated})


def encode_flags(df: DataFrame, flags: list[str]) -> DataFrame:
    return df.withColumns({name: truthy(F.col(name), MODEL_TRUE).cast("double") for name in flags if name in df.columns})


def fill_features(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Absent inputs become 0, null numbers 0, null categories a category of their own."""
    present = set(df.columns)
    numbers = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in present else F.lit(0.0) for n in numeric}
    texts = {
        n: F.coalesce(F.col(n).cast("string"), F.lit(MISSING_CATEGORY)) if n in present else F.lit("0")
        for n in categorical
    }
    return df.withColumns({**numbers, **texts})


def prepare(df: DataFrame, spend_columns: list[str]) -> DataFrame:
    """One preparation for training and scoring: context, flags, filled numbers and categories."""
    return fill_features(encode_flags(campaign_context(df), FLAGS), [*FLAGS, *numeric_inputs(spend_columns), *CONTEXT], CATEGORICAL)


def temporal_cutoff(df: DataFrame, send_date: str, campaign: str, share: float = 0.8) -> DataFrame:
    """Send date at position ``int(n * share)`` of the campaigns ordered by their last send, as one row.

    Works on one row per campaign.
    """
    last = df.groupBy(campaign).agg(F.max(send_date).alias("last"))
    dates = last.groupBy("last").agg(F.count(F.lit(1)).alias("n"))
    # one row a date: the running count is as short as the calendar
    upto = dates.select("last", F.sum("n").over(Window.orderBy("last")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return upto.where(F.col("upto") > F.expr(f"CAST(total * CAST({share} AS DOUBLE) AS BIGINT)")).agg(F.min("last").alias("cutoff"))


def temporal_split(df: DataFrame, send_date: str, campaign: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Campaigns sent up to the cutoff train, later ones test."""
    cutoff = temporal_cutoff(df, send_date, campaign, share).scalar()
    return df.where(F.col(send_date) <= cutoff), df.where(F.col(send_date) > cutoff)


def check_split(test: DataFrame, label: str) -> None:
    found = test.agg(F.count_if(F.col(label)).alias("pos")).first()
    if not found.pos:
        raise ValueError("the test period has no positives: start the training range earlier")


def feature_names(spend_columns: list[str]) -> list[str]:
    return [*[f"{c}_code" for c in CATEGORICAL], *FLAGS, *numeric_inputs(spend_columns), *CONTEXT]


def train(df: DataFrame, label: str, spend_columns: list[str], trees: int = TREES, depth: int = DEPTH) -> Bundle:
    """Boosted trees over prepared rows, categories as codes by label order."""
    codes = encoding.code_table(df, CATEGORICAL)
    inputs = feature_names(spend_columns)
    rows = materialize(encoding.with_codes(df, codes, CATEGORICAL).select(F.col(label).alias("label"), *inputs), "training-codes")
    fitted = boosting.fit(rows, inputs, "label", replace(BOOSTING, trees=trees, depth=depth), max(1, rows.count() // ROWS_PER_TASK))
    return Bundle(codes, fitted, spend_columns, None, {"importance": fitted.importance(), "trees": trees, "depth": depth})


def score(bundle: Bundle, df: DataFrame, out: str = "p", keep: list[str] | None = None) -> DataFrame:
    """Probability of the positive class for prepared rows; ``keep``: the only other columns that are wanted back."""
    if keep is not None:
        return bundle.trees.score(encoding.with_codes(df, bundle.codes, CATEGORICAL), out, keep)
    return bundle.trees.score(encoding.with_codes(df, bundle.codes, CATEGORICAL), out).drop(*[f"{c}_code" for c in CATEGORICAL])


def train_propensity(df: DataFrame, label: str) -> PipelineModel:
    """A model of its own over the propensity inputs, per customer."""
    stages = [
        VectorAssembler(inputCols=PROPENSITY, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features"),
        LogisticRegression(labelCol="label", featuresCol="features", regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(fill_features(df, PROPENSITY, []).withColumn("label", F.col(label).cast("double")))


def propensity_scores(model: PipelineModel | None, customers: DataFrame) -> DataFrame:
    """``cust_id, propensity_score``; absent or null inputs are 0, without a model the score is null."""
    if model is None:
        return customers.select("cust_id", F.lit(None).cast("double").alias("propensity_score"))
    scored = model.transform(fill_features(customers.select("cust_id", *[c for c in PROPENSITY if c in customers.columns]), PROPENSITY, []))
    return scored.select("cust_id", vector_to_array("probability")[1].alias("propensity_score"))


def isotonic(df: DataFrame, p: str, label: str) -> DataFrame:
    """Monotone map of scores to observed rates, as steps."""
    return steps.fit(df, p, label)


def sample_ratio(model: DataFrame, df: DataFrame, p: str, base_rate: float) -> float:
    """Odds of the base rate over odds of the mean calibrated score."""
    mapped = steps.apply(model, df, p, "_iso")
    return mapped.agg(F.avg("_iso").alias("mean")).select(prior_ratio(F.lit(base_rate), F.col("mean")).alias("r")).first().r


def calibrate(model: DataFrame, df: DataFrame, p: str, base_rate: float, out: str = "cal") -> DataFrame:
    """Isotonic map, then prior correction from the sampled mean to the real base rate."""
    mapped = steps.apply(model, df, p, "_iso")
    return mapped.withColumn(out, prior_correct(F.col("_iso"), F.lit(sample_ratio(model, df, p, base_rate)))).drop("_iso")


def importance(bundle: Bundle, spark: SparkSession) -> DataFrame:
    """All feature importances with their place; a report shows the first ones."""
    ordered = sorted(bundle.facts["importance"].items(), key=lambda x: (-x[1], x[0]))
    rows = [(name, weight, place) for place, (name, weight) in enumerate(ordered, 1)]
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE, place INT")


def _scored_with_segment(bundle: Bundle, rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    kept = rows.withColumn("_segment", F.col("rfm_segment"))
    names = keep and ["_segment" if name == "rfm_segment" else name for name in keep]
    return score(bundle, prepare(kept, bundle.spend_columns), keep=names).drop("rfm_segment").withColumnRenamed("_segment", "rfm_segment")


def predict_audience(bundle: Bundle, audience: DataFrame, send_date: dt.date) -> DataFrame:
    """Probability of each customer of a future send, all treated, corrected by the prior as nothing is observed yet."""
    planned = audience.withColumns({"fecha_envio": F.lit(send_date), "gmgc": F.lit("GM")})
    return _scored_with_segment(bundle, planned).withColumn("p_5dias", prior_correct(F.col("p"), F.lit(bundle.facts["prior_ratio"])))


def predict_campaigns(bundle: Bundle, audience: DataFrame, features: DataFrame, outcome: str = "canjeo", keep: list[str] | None = None) -> DataFrame:
    """Probability of each customer send at the campaign's latest date, rescaled per campaign to its observed rate.

    Scores are stored, as their means are needed before they are scaled. ``keep``: the columns wanted, with the campaign and the outcome.
    """
    dates = audience.groupBy("nombre_campanha").agg(F.max("fecha_envio").alias("_latest"))
    rows = audience.join(dates, "nombre_campanha").withColumn("fecha_envio", F.col("_latest")).drop("_latest").join(features, "cust_id", "left")
    scored = materialize(_scored_with_segment(bundle, rows, keep), "campaign-scores")
    return rescale_to_rate(scored, "p", outcome, bundle.facts["prior_ratio"], ["nombre_campanha"])
