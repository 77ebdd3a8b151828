"""Writers. Partitioned writes are rebalanced, so a hot partition value is split over tasks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from stampcard.sources import commits


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet write.

    With ``partition_by`` the rows are first rebalanced on those columns: adaptive execution packs
    small partition values into one task and splits a value that holds a large share of the rows.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_dates(df: DataFrame, path: str, date_col: str, replaced: tuple[dt.date, dt.date] | None = None) -> None:
    """Write ``df`` by date as a new version and commit which version each date is read from.

    Without ``replaced`` the rows are the whole dataset. With it they are those of the days from the first to the last, inclusive: other days stay as
    they are, and days of the range without rows are gone. Readers (``scans.read_dates``) see all of it or nothing. Rows without a date or outside the range
    are refused.
    """
    spark = df.sparkSession
    outside = F.col(date_col).isNull()
    if replaced:
        outside = outside | ~F.col(date_col).between(F.lit(replaced[0]), F.lit(replaced[1]))
    if not df.where(outside).isEmpty():
        raise ValueError(f"{path}: rows without a date, or outside the days to replace")
    after, state = commits.latest(spark, path)
    version = commits.new_version()
    write_parquet(df, f"{path}/{version}", [date_col])
    kept = {day: v for day, v in state.get("days", {}).items() if replaced and not replaced[0].isoformat() <= day <= replaced[1].isoformat()}
    written = {name.split("=", 1)[1]: version for name in commits.folders(spark, f"{path}/{version}") if "=" in name}
    commits.commit(spark, path, {"column": date_col, "days": kept | written}, after)


def write_metrics(metrics: DataFrame, path: str, replaced: tuple[dt.date, dt.date] | None = None) -> None:
    """Metrics cube by send date, whole or for a range of days."""
    write_dates(metrics, path, "FECHA_ENVIO", replaced)


def individual_rows(scored: DataFrame) -> DataFrame:
    """Customer-level rows in their stored form: boolean outcome, single-precision score."""
    return scored.select(
        "NOMBRE_CAMPANHA", "GMGC", "cust_id", "rfm_segment",
        F.col("propensity_score").cast("float").alias("propensity_score"),
        (F.col("FLAG_CANJE") == "CANJEO").alias("canjeo"),
    )


def write_individual(scored: DataFrame, path: str) -> None:
    """Replace the customer-level dataset, one folder per campaign."""
    write_parquet(individual_rows(scored), path, partition_by=["NOMBRE_CAMPANHA"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
