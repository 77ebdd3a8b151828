"""Guarded ratios, lifts and colour bands. ANSI mode stays on, so every division is guarded."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rate(part: Column, whole: Column, decimals: int = 1) -> Column:
    """Percentage of ``whole``; null where the whole is zero or null."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), decimals)


def spct(part: Column, whole: Column, decimals: int = 1) -> Column:
    """Percentage rounded half-up; 0.0 where the whole is null, zero or negative."""
    return F.when(whole > 0, F.coalesce(rate(part, whole, decimals), F.lit(0.0))).otherwise(F.lit(0.0))


def floored_lift(treated_pct: Column, control_pct: Column, decimals: int = 2) -> Column:
    return F.greatest(F.lit(0.0), F.round(treated_pct - control_pct, decimals))


def clip01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def band_pivot(pct: Column) -> Column:
    """Traffic light of the segment pivot."""
    return F.when(pct >= 10, "green").when(pct >= 5, "yellow").when(pct > 0, "red")


def band_heat(pct: Column) -> Column:
    """Four-step heat of the segment breakdown."""
    return F.when(pct >= 10, "4").when(pct >= 6, "3").when(pct >= 3, "2").when(pct > 0, "1")


def band_gap(gap: Column) -> Column:
    """Calibration quality by absolute gap in percentage points."""
    size = F.abs(gap)
    return F.when(size <= 5, "good").when(size <= 10, "fair").when(size > 10, "poor")


def band_mean(value: Column, mean: Column) -> Column:
    """Position against the column mean: over 110 %, under 90 %, or between."""
    return (
        F.when(value.isNull(), None)
        .when(value > mean * 1.1, "green")
        .when(value < mean * 0.9, "red")
        .otherwise("yellow")
    )


def band_lift(lift: Column) -> Column:
    return F.when(lift > 1, "green").when(lift < -1, "red")
