"""Segment profile, calibration of a propensity score, audience selection and plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stampcard.functions.ratios import band_gap, spct
from stampcard.functions.text import position_in
from stampcard.operators.ranking import exact_quantile
from stampcard.operators.reports import clients_where
from stampcard.operators.rfm import RFM_ORDER
from stampcard.sources.filters import Filters, apply_filters
from stampcard.sources.scans import resolve_column

# Fixed value: points per redemption when no column tells.
DEFAULT_POINTS = 5000.0

_MEANS = ["r_score", "f_score", "m_score", "recency_days", "frequency_total", "monetary_total", "stock_points"]


def segment_kpis(rfm: DataFrame) -> DataFrame:
    """Customers, segments and median recency. Recency has few distinct values, so the exact median is small state."""
    return rfm.agg(
        F.count(F.lit(1)).alias("customers"),
        F.countDistinct("rfm_segment").alias("segments"),
        F.median("recency_days").alias("median_recency"),
    )


def segment_profile(rfm: DataFrame) -> DataFrame:
    """Size, share of base, means and most frequent priority per segment (ties: alphabetical), in report order."""
    per_priority = rfm.groupBy("rfm_segment", "prioridad").agg(
        F.count("cust_id").alias("n"),
        *[F.sum(c).alias(f"sum_{c}") for c in _MEANS],
        *[F.count(c).alias(f"n_{c}") for c in _MEANS],
    )
    top = Window.partitionBy("rfm_segment").orderBy(F.col("n").desc(), F.col("prioridad"))
    ranked = per_priority.withColumn("_rank", F.row_number().over(top))
    profile = ranked.groupBy("rfm_segment").agg(
        F.sum("n").alias("customers"),
        *[F.round(F.try_divide(F.sum(f"sum_{c}"), F.sum(f"n_{c}")), 4).alias(f"mean_{c}") for c in _MEANS],
        F.max(F.when(F.col("_rank") == 1, F.col("prioridad"))).alias("priority"),
    )
    total = per_priority.agg(F.sum("n")).scalar()
    return profile.withColumn("pct_base", spct(F.col("customers"), total)).orderBy(position_in(F.col("rfm_segment"), RFM_ORDER))


def calibration_by_segment(rfm: DataFrame, rfm_cube: DataFrame) -> DataFrame:
    """Mean predicted propensity against observed rates per segment, with the gap and its band.

    Segments without treated customers have nothing to compare with and are left out.
    """
    predicted = rfm.dropna(subset=["propensity_score"]).groupBy("rfm_segment").agg(
        F.round(F.avg("propensity_score") * 100, 2).alias("predicted_pct")
    )
    treated, control = F.col("GMGC") == "GM", F.col("GMGC") == "GC"
    redeemed = F.col("FLAG_CANJE") == "CANJEO"
    observed = rfm_cube.groupBy("rfm_segment").agg(
        clients_where(treated).alias("total_gm"),
        clients_where(treated & redeemed).alias("redeemers_gm"),
        clients_where(control).alias("total_gc"),
        clients_where(control & redeemed).alias("redeemers_gc"),
    )
    known = observed.where(F.col("total_gm") > 0)
    joined = predicted.where(F.col("rfm_segment").isin(RFM_ORDER)).join(known, "rfm_segment")
    real_gm = spct(F.col("redeemers_gm"), F.col("total_gm"))
    real_gc = F.when(F.col("total_gc") > 0, spct(F.col("redeemers_gc"), F.col("total_gc")))
    rows = joined.select(
        "rfm_segment", "total_gm", "predicted_pct",
        real_gm.alias("real_gm_pct"), real_gc.alias("real_gc_pct"),
        F.round(F.col("predicted_pct") - real_gm, 1).alias("gap_pp"),
    )
    return rows.withColumn("band", band_gap(F.col("gap_pp"))).orderBy(position_in(F.col("rfm_segment"), RFM_ORDER))


def calibration_kpis(calibration: DataFrame) -> DataFrame:
    """Mean absolute gap and bias over the segments."""
    return calibration.agg(
        F.count(F.lit(1)).alias("segments"),
        F.round(F.avg(F.abs("gap_pp")), 1).alias("mae_pp"),
        F.round(F.avg("gap_pp"), 1).alias("bias_pp"),
    )


def audience(rfm: DataFrame, filters: Filters) -> DataFrame:
    return apply_filters(rfm, filters)


def audience_size(rfm: DataFrame, filters: Filters) -> DataFrame:
    return audience(rfm, filters).agg(F.count(F.lit(1)).alias("audience"))


def average_points(rfm: DataFrame, candidates: list[str], tie: str = "cust_id") -> float:
    """Exact median of the first candidate column present, or a fixed default without one."""
    column = resolve_column(rfm, candidates)
    if column is None:
        return DEFAULT_POINTS
    median = exact_quantile(rfm, column, tie, [0.5])
    return median[0] if median else DEFAULT_POINTS


def audience_plan(scored: DataFrame, value_per_point: float, avg_points: float) -> DataFrame:
    """Expected redeemers, conversion, points and cost per segment, best conversion first."""
    plan = scored.dropna(subset=["rfm_segment"]).groupBy("rfm_segment").agg(
        F.count("cust_id").alias("audience"), F.sum("p_5dias").alias("expected")
    )
    points = F.col("expected") * F.lit(avg_points)
    return plan.select(
        "rfm_segment", "audience",
        F.round("expected", 4).alias("expected_redeemers"),
        F.round(F.col("expected") / F.col("audience") * 100, 4).alias("conv_pct"),
        F.round(points, 2).alias("expected_points"),
        F.round(points * value_per_point, 4).alias("expected_cost"),
    ).orderBy(F.col("conv_pct").desc(), "rfm_segment")


def plan_totals(scored: DataFrame, value_per_point: float, avg_points: float) -> DataFrame:
    """Audience, expected redeemers, conversion, points and cost in one row."""
    totals = scored.agg(F.count(F.lit(1)).alias("audience"), F.coalesce(F.sum("p_5dias"), F.lit(0.0)).alias("expected"))
    points = F.col("expected") * F.lit(avg_points)
    return totals.select(
        "audience",
        F.round("expected", 4).alias("expected_redeemers"),
        F.round(F.col("expected") / F.greatest("audience", F.lit(1)) * 100, 4).alias("conv_pct"),
        F.round(points, 2).alias("expected_points"),
        F.round(points * value_per_point, 4).alias("expected_cost"),
    )
