"""Report filters as job parameters."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from stampcard.sources.scans import resolve_column


@dataclass(frozen=True)
class Filters:
    """Empty lists and missing dates filter nothing."""

    start: dt.date | None = None
    end: dt.date | None = None
    client_types: list[str] = field(default_factory=list)
    tiers: list[str] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)


def apply_filters(df: DataFrame, filters: Filters) -> DataFrame:
    """Apply every filter whose column the frame has."""
    send_date = resolve_column(df, ["FECHA_ENVIO", "fecha_envio", "INICIO_VIGENCIA", "inicio_vigencia"])
    client_type = resolve_column(df, ["TIPO_CLIENTE", "tipo_cliente"])
    tier = resolve_column(df, ["tier", "TIER", "categoria", "CATEGORIA"])
    segment = resolve_column(df, ["rfm_segment"])
    if send_date and filters.start:
        df = df.where(F.col(send_date) >= F.lit(filters.start))
    if send_date and filters.end:
        df = df.where(F.col(send_date) <= F.lit(filters.end))
    if client_type and filters.client_types:
        df = df.where(F.col(client_type).isin(filters.client_types))
    if tier and filters.tiers:
        df = df.where(F.upper(tier).isin([name.upper() for name in filters.tiers]))
    if segment and filters.segments:
        df = df.where(F.col(segment).isin(filters.segments))
    return df


def search_campaign(df: DataFrame, pattern: str, column: str = "campaign") -> DataFrame:
    """Case-insensitive regular expression on the campaign name; null names never match."""
    return df.where(F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False)))


def drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Grouping keys must be known, as a data-frame group-by drops null keys and SQL does not."""
    return df.dropna(subset=keys)


def distinct_values(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Distinct non-null values, sorted for a picker."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return values.orderBy(F.col(column).desc() if descending else F.col(column).asc())


def slice_campaign(df: DataFrame, send_date: dt.date, campaign: str) -> DataFrame:
    return df.where((F.col("FECHA_ENVIO") == F.lit(send_date)) & (F.col("NOMBRE_CAMPANHA") == campaign))
