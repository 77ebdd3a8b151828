"""Recency, frequency and money scores, segments and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stampcard.functions.text import label_of
from stampcard.operators.ranking import quintiles

# Segment order of the reports, priority per segment.
RFM_ORDER = ["Champions", "Loyal", "Nuevos", "En Riesgo", "Perdidos", "Otros"]
NO_SCORE = "Sin score RFM"
PRIORITY = {
    "Champions": "Alta",
    "Loyal": "Alta",
    "En Riesgo": "Media",
    "Nuevos": "Media",
    "Perdidos": "Baja",
    "Otros": "Baja",
}

SCORES = {
    "r_score": ("recency_days", False),
    "f_score": ("frequency_total", True),
    "m_score": ("monetary_total", True),
}


def rfm_scores(df: DataFrame, tie: str = "cust_id") -> DataFrame:
    """Quintile scores of unique ranks. ``df`` is read several times: pass a stored table."""
    return quintiles(df, SCORES, tie)


def rfm_segment(mode: str = "reference") -> Column:
    """Segment of the three scores.

    In reference order "En Riesgo" can never be reached, as "Loyal" covers it; ``mode="strict"`` tests it first.
    """
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    rules = [
        ("Champions", (r >= 4) & (f >= 4) & (m >= 4)),
        ("Loyal", (f >= 3) & (m >= 3)),
        ("Nuevos", (r >= 4) & (f <= 2)),
        ("En Riesgo", (r <= 2) & (f >= 3) & (m >= 3)),
        ("Perdidos", (r <= 2) & (f <= 2) & (m <= 2)),
    ]
    if mode == "strict":
        rules.insert(1, rules.pop(3))
    elif mode != "reference":
        raise ValueError(f"unknown mode {mode!r}")
    out = F
    for label, rule in rules:
        out = out.when(rule, label)
    return out.otherwise("Otros")


def priority(segment: Column) -> Column:
    return label_of(segment, PRIORITY)


def rfm_table(features: DataFrame, spend_columns: list[str], mode: str = "reference") -> DataFrame:
    """Features with entropy, scores, segment, priority and the derived model features."""
    from stampcard.operators.features import channel_entropy, derived_features

    scored = rfm_scores(features).withColumn("retailer_entropy", channel_entropy(spend_columns))
    return derived_features(
        scored.withColumn("rfm_segment", rfm_segment(mode)).withColumn("prioridad", priority(F.col("rfm_segment")))
    )
