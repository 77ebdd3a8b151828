"""Scans with pushed-down ranges, tolerant column sets and typed normalisation."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DateType, StringType, StructType, TimestampType

from stampcard.functions.dates import last_closed_month
from stampcard.sources import commits

# Columns of the e-mail feed and of the send-base export.
EMAIL_COLUMNS = [
    "id_jobenvio", "campaign_name", "casos", "inicio_vigencia", "fin_vigencia", "flag_vigencia", "desc_emailname",
    "desc_asunto", "total_mails", "total_opens", "total_clicks", "total_bounces", "total_unsubs", "porc_envio",
]
SEND_COLUMNS = [
    "fecha_envio", "nombre_campanha", "tipo_cliente", "canal", "tipo_medicion", "tipo_campanha", "gmgc",
    "inicio_vigencia", "fin_vigencia",
]


def scan_range(df: DataFrame, date_col: str, start: dt.date, end: dt.date, columns: list[str] | None = None) -> DataFrame:
    """Inclusive date range with an optional projection; both reach the Parquet scan."""
    ranged = df.where(F.col(date_col).between(F.lit(start), F.lit(end)))
    return ranged.select(*columns) if columns else ranged


def snapshot_at_last_close(df: DataFrame, today: dt.date, partition_col: str = "partition_date") -> DataFrame:
    """One partition, the month end before ``today``, as a literal so that static pruning applies."""
    return df.where(F.col(partition_col) == F.lit(last_closed_month(today)))


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order, each once."""
    present = {name.lower() for name in df.columns}
    return df.select(*[name for name in dict.fromkeys(wanted) if name.lower() in present])


def read_campaign(spark: SparkSession, root: str, campaign: str, columns: list[str] | None = None) -> DataFrame:
    """One campaign of a dataset partitioned by campaign; only its folder is listed and read."""
    df = spark.read.parquet(root).where(F.col("NOMBRE_CAMPANHA") == campaign)
    return df.select(*columns) if columns else df


def read_dates(spark: SparkSession, path: str, contract: StructType, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """The committed state of a dataset by date (``sinks.write_dates``); only folders of the wanted days are listed and read."""
    _, state = commits.latest(spark, path)
    days: dict[str, list[str]] = {}
    for day, version in sorted(state.get("days", {}).items()):
        if (start is None or day >= start.isoformat()) and (end is None or day <= end.isoformat()):
            days.setdefault(version, []).append(day)
    parts = [
        spark.read.schema(contract).option("basePath", f"{path}/{version}").parquet(*[f"{path}/{version}/{state['column']}={day}" for day in own]).select(*contract.names)
        for version, own in days.items()
    ]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], contract)


def normalize_types(df: DataFrame, contract: StructType) -> DataFrame:
    """Cast to the declared types; values that do not parse become null instead of failing."""
    present = {name.lower(): name for name in df.columns}
    typed = []
    for field in contract:
        name = present.get(field.name.lower())
        if name is None:
            continue
        column = F.col(name)
        if isinstance(field.dataType, (DateType, TimestampType, BooleanType)) and not isinstance(
            df.schema[name].dataType, StringType
        ):
            typed.append(column.cast(field.dataType).alias(field.name))
        else:
            typed.append(column.try_cast(field.dataType).alias(field.name))
    return df.select(*typed)


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.upper() for name in df.columns])


def resolve_column(df: DataFrame, candidates: list[str]) -> str | None:
    """First candidate present in the frame, or None."""
    return next((name for name in candidates if name in df.columns), None)


def scan_month_column(df: DataFrame, start: dt.date, month_col: str = "mes", whole_month: bool = True) -> DataFrame:
    """Redemptions from ``start`` on by their month column, from the first of its month.

    As the column holds the first of the month, comparing it with a mid-month start as it stands drops that month;
    ``whole_month=False`` does so.
    """
    first = start.replace(day=1) if whole_month else start
    return df.where(F.col(month_col) >= F.lit(first))


def dataset_summary(df: DataFrame, customer: str, segment: str, missing_label: str = "Sin score RFM") -> DataFrame:
    """Rows, distinct customers, segments and rows with a known segment, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(customer).alias("n_customers"),
        F.countDistinct(segment).alias("n_segments"),
        F.count_if(F.col(segment) != missing_label).alias("n_scored"),
    )
