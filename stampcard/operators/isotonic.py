"""Isotonic regression without one sort, one task or the driver.

The fit is the slope of the greatest convex curve below the running sums of the points in order of the score. A task finds the convex pieces
(blocks of equal fit) of its range of scores; blocks of neighbouring ranges are merged, ``FAN_IN`` ranges at a time, by the same rule: a block that does not
rise above the one before it joins it. Merging keeps the fit, as pooling may begin anywhere.

Between blocks the fit is linear, beyond the ends it is constant. A model that fits a task is sent to all; a larger one is joined by buckets of the score.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stampcard.operators.evaluation import score_counts
from stampcard.operators.ranking import bucketize
from stampcard.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no install of it

FAN_IN = 16
#: Blocks that may be sent to all tasks: 24 bytes each.
SENT = 1_000_000
_BLOCK = T.StructType([T.StructField("part", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("low", "high", "rows", "total")])


class Blocks:
    """Blocks in order, pooled while they do not rise."""

    def __init__(self):
        self.held: list[list[float]] = []

    def add(self, low: float, high: float, rows: float, total: float) -> None:
        held, block = self.held, [low, high, rows, total]
        while held and held[-1][3] * block[2] >= block[3] * held[-1][2]:
            last = held.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        held.append(block)


def _pool(rows: DataFrame, fan_in: int) -> DataFrame:
    """Blocks of each partition, which holds neighbouring points or blocks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = None, Blocks()

        def ready() -> pa.RecordBatch:
            columns = list(zip(*blocks.held))
            return pa.RecordBatch.from_arrays([pa.array([at] * len(blocks.held), pa.int64()), *(pa.array(c, pa.float64()) for c in columns)], names=_BLOCK.names)

        for batch in batches:
            for part, *block in zip(*(c.to_pylist() for c in batch.columns)):
                part = TaskContext.get().partitionId() if part is None else part // fan_in
                if at is not None and part != at:
                    yield ready()
                    blocks = Blocks()
                at = part
                blocks.add(*block)
        if at is not None:
            yield ready()

    return rows.mapInArrow(run, _BLOCK)


def fit(df: DataFrame, score: str, label: str, fan_in: int = FAN_IN) -> DataFrame:
    """``low, high, rows, value``: the steps of the fit, one a row: scores from ``low`` to ``high`` have ``value``. Rows without a score or a label are left out."""
    counted = score_counts(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()), score, label)
    points = materialize(counted.select(
        F.lit(None).cast("long").alias("part"), F.col("score").cast("double").alias("low"), F.col("score").cast("double").alias("high"),
        (F.col("pos") + F.col("neg")).cast("double").alias("rows"), F.col("pos").cast("double").alias("total"),
    ), "isotonic-points")
    blocks = materialize(_pool(points.repartitionByRange("low").sortWithinPartitions("low"), fan_in), "isotonic-blocks")
    while blocks.select("part").distinct().limit(2).count() > 1:
        grouped = blocks.repartition(F.floor(F.col("part") / fan_in)).sortWithinPartitions(F.floor(F.col("part") / fan_in), "low")
        blocks = materialize(_pool(grouped, fan_in), "isotonic-blocks")
    return blocks.select("low", "high", "rows", (F.col("total") / F.col("rows")).alias("value"))


def apply(steps: DataFrame, df: DataFrame, score: str, out: str) -> DataFrame:
    """``df`` with the fitted value of the score; null scores and a model without steps give null."""
    if steps.count() <= SENT:
        return _sent(steps, df, score, out)
    return _joined(steps, df, score, out)


def _sent(steps: DataFrame, df: DataFrame, score: str, out: str) -> DataFrame:
    known = sorted(tuple(r) for r in steps.select("low", "high", "value").collect())
    x = np.array([e for low, high, _ in known for e in (low, high)])
    y = np.array([v for *_, v in known for _ in range(2)])
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.DoubleType())])
    kept = df.select(*[f"`{f.name}`" for f in schema.fields[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(score).cast(pa.float64())
            missing = np.asarray(column.is_null()) | (len(x) == 0)
            found = np.interp(np.asarray(column.fill_null(0.0)), x, y) if len(x) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64(), mask=missing)], names=schema.names)

    return kept.mapInArrow(run, schema)


def _joined(steps: DataFrame, df: DataFrame, score: str, out: str, buckets: int | None = None) -> DataFrame:
    """The same by an equi-join on buckets of the score that begin at steps, so that each score finds its step in its own bucket."""
    n = buckets or min(10_000, max(2, steps.count() // 1000))
    shares = ", ".join(f"{k / n!r}D" for k in range(1, n))
    cuts = sorted(set(steps.agg(F.expr(f"percentile_approx(low, array({shares}), {20 * n})").alias("e")).first().e or []))
    placed = bucketize(steps, "low", cuts, "__bucket")
    starts = placed.groupBy("__bucket").agg(F.min("low").alias("__low"), F.min_by("value", "low").alias("__value"))
    following = Window.orderBy("__bucket")  # one row a bucket
    after = starts.select("__bucket", F.lead("__low").over(following).alias("__low"), F.lead("__value").over(following).alias("__value"), (F.row_number().over(following) == 1).alias("__first"))
    inside = Window.partitionBy("__bucket").orderBy("low")
    known = placed.join(after, "__bucket").select(
        "__bucket", F.when(F.col("__first") & (F.row_number().over(inside) == 1), float("-inf")).otherwise(F.col("low")).alias("__from"), F.col("high").alias("__high"), F.col("value").alias("__at"),
        F.coalesce(F.lead("low").over(inside), "__low").alias("__next"), F.coalesce(F.lead("value").over(inside), "__value").alias("__then"),
    )
    asked = bucketize(df, score, cuts, "__bucket")
    here = (F.col(score) >= F.col("__from")) & (F.col("__next").isNull() | (F.col(score) < F.col("__next")))
    met = asked.withColumnRenamed("__bucket", "__asked").join(known, (F.col("__asked") == F.col("__bucket")) & here, "left")
    way = F.col("__at") + (F.col("__then") - F.col("__at")) * (F.col(score) - F.col("__high")) / F.nullif(F.col("__next") - F.col("__high"), F.lit(0.0))
    value = F.when((F.col(score) <= F.col("__high")) | F.col("__next").isNull(), F.col("__at")).otherwise(way)
    return met.withColumn(out, value).drop("__asked", "__bucket", "__from", "__high", "__at", "__next", "__then")
