"""Redemptions attributed to sends by validity window or fixed horizon."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from stampcard.operators.features import not_returned


def first_redemption(rdm: DataFrame) -> DataFrame:
    return rdm.where(not_returned()).groupBy("cust_id").agg(F.min("redemption_date").alias("primer_canje"))


def redemption_daily(rdm: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Redemptions and points per customer, day and channel."""
    ranged = rdm.where(F.col("redemption_date").between(F.lit(start), F.lit(end)) & not_returned())
    return ranged.groupBy("redemption_date", "cust_id", "bu_channel_name").agg(
        F.count("redemption_id_unico").alias("canjes"), F.sum("redemption_points_amt").alias("puntos_canjeados")
    )


def redemption_days(rdm: DataFrame, start: dt.date, whole_month: bool = True) -> DataFrame:
    """Sorted distinct redemption days per customer, read through the month column.

    A list holds at most one entry per calendar day since ``start``, however many redemptions a customer has.
    """
    from stampcard.sources.scans import scan_month_column

    kept = scan_month_column(rdm, start, whole_month=whole_month).where(not_returned())
    return kept.groupBy("cust_id").agg(F.sort_array(F.collect_set("redemption_date")).alias("days"))


def send_windows(sends: DataFrame, start: dt.date, end: dt.date, *window: str) -> DataFrame:
    """Distinct customer sends in the date range, with their window columns."""
    ranged = sends.where(F.col("fecha_envio").between(F.lit(start), F.lit(end)))
    return ranged.select("fecha_envio", "nombre_campanha", "gmgc", F.col("rut").alias("cust_id"), *window).distinct()


def _flagged(windows: DataFrame, days: DataFrame, first, last) -> DataFrame:
    """Join each window to one list of days per customer; no window is paired with single redemptions."""
    inside = F.exists("days", lambda day: day.between(first, last))
    return windows.join(days, "cust_id", "left").withColumn("hit", F.coalesce(inside, F.lit(False)))


def attribute_redemptions(sends: DataFrame, rdm: DataFrame, start: dt.date, end: dt.date, mode: str = "reference",
                          whole_month: bool = True) -> DataFrame:
    """CANJEO / NO CANJEO per customer send, by validity window.

    A customer may have several windows in one send. In reference mode the flag is the alphabetical maximum, so
    one unmatched window makes the send NO CANJEO; ``mode="any"`` takes any match, ``mode="both"`` adds it as ``flag_any``.
    """
    windows = send_windows(sends, start, end, "inicio_vigencia", "fin_vigencia")
    hits = _flagged(windows, redemption_days(rdm, start, whole_month), F.col("inicio_vigencia"), F.col("fin_vigencia"))
    flag = lambda hit, name: F.when(hit, "CANJEO").otherwise("NO CANJEO").alias(name)
    flags = {"reference": [flag(F.bool_and("hit"), "flag_canje")], "any": [flag(F.bool_or("hit"), "flag_canje")]}
    flags["both"] = [*flags["reference"], flag(F.bool_or("hit"), "flag_any")]
    return hits.groupBy("fecha_envio", "nombre_campanha", "gmgc", "cust_id").agg(*flags[mode])


def attribute_redemptions_horizon(sends: DataFrame, rdm: DataFrame, start: dt.date, end: dt.date, days: int = 5,
                                  whole_month: bool = True) -> DataFrame:
    """Whether the customer redeemed within ``days`` days of the send, both ends included."""
    windows = send_windows(sends, start, end)
    last = F.date_add("fecha_envio", days)
    hits = _flagged(windows, redemption_days(rdm, start, whole_month), F.col("fecha_envio"), last)
    return hits.select("fecha_envio", "nombre_campanha", "gmgc", "cust_id", F.col("hit").alias("canjeo_5d"))
