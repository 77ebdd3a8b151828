"""Codes of category labels as a table, made and applied by sorts and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stampcard.session import materialize

UNKNOWN = -1.0


def code_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, label, code``: the labels of each column numbered from 0 in their order (that of their bytes). Nulls have no code.

    Labels are sorted by ranges over all tasks; a label's place is its place in its range plus the labels of the column before the range, so
    neither one task nor the driver sees all labels."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("label")) for c in columns]))
    labels = df.select(pairs).where("label IS NOT NULL").distinct()
    ordered = labels.repartitionByRange("feature", "label").sortWithinPartitions("feature", "label")
    # the upper bits of these numbers are the range, the lower ones the place in it
    placed = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "label-places")
    ranges = placed.groupBy("feature", F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    # one row a column and range: as short as the list of tasks
    before = Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(ranges.select("feature", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "label-offsets")
    coded = placed.withColumn("range", F.shiftright("place", 33)).join(offsets, ["feature", "range"])
    return materialize(coded.select("feature", "label", (F.col("offset") + F.col("place") - F.col("first")).cast("double").alias("code")), "label-codes")


def with_codes(df: DataFrame, codes: DataFrame, columns: list[str], suffix: str = "_code") -> DataFrame:
    """``df`` with the code of each column; labels that the table lacks, and nulls, get -1. The stored size of the table decides how it is joined."""
    for c in columns:
        known = codes.where(F.col("feature") == c).select(F.col("label").alias("__label"), F.col("code").alias("__code"))
        df = df.join(known, F.col(f"`{c}`").cast("string") == F.col("__label"), "left")
        df = df.withColumn(f"{c}{suffix}", F.coalesce("__code", F.lit(UNKNOWN))).drop("__label", "__code")
    return df
