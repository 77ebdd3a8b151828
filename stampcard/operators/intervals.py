"""Range joins expressed as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stampcard.functions.dates import month_index
from stampcard.session import materialize

#: Rows of either side that one key and month may bring into a task.
TILE_ROWS = 100_000


def _by_month(windows: DataFrame, events: DataFrame, first: str, last: str, day: str) -> tuple[DataFrame, DataFrame]:
    months = F.sequence(month_index(F.col(first)), month_index(F.col(last)))
    return (
        windows.where(F.col(first) <= F.col(last)).withColumn("_month", F.explode(months)),
        events.withColumn("_month", month_index(F.col(day))),
    )


def busy_months(windows: DataFrame, events: DataFrame, key: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``key, _month, _w, _e``: into how many tiles windows and events are dealt, where that is more than one for either side.

    There are at most as many rows as tiles, so the table is smaller than either side by ``tile_rows``.
    """
    counted = lambda df, one: df.groupBy(key, "_month").agg(F.count(F.lit(1)).alias(one))
    both = counted(windows, "_nw").join(counted(events, "_ne"), [key, "_month"])
    tiles = lambda n: F.ceil(F.col(n) / tile_rows).cast("int")
    return both.select(key, "_month", tiles("_nw").alias("_w"), tiles("_ne").alias("_e")).where("_w > 1 OR _e > 1")


def dealt(windows: DataFrame, events: DataFrame, key: str, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with a tile ``_i`` of the windows and ``_j`` of the events.

    A row has one tile of its own side, from a hash of its values, and is repeated for each tile of the other side, so
    every pair meets in one tile. Rows that repeat all values share a tile.
    """
    busy = materialize(busy_months(windows, events, key, tile_rows), "busy-months")

    def deal(df: DataFrame, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        values = df.columns
        known = df.join(busy, [key, "_month"], "left")
        count = lambda name: F.coalesce(F.col(name), F.lit(1))
        mine: Column = F.pmod(F.xxhash64(*values), count(own[1])).cast("int")
        return known.withColumn(own[0], mine).withColumn(other[0], F.explode(F.sequence(F.lit(0), count(other[1]) - 1))).select(*values, "_i", "_j")

    return deal(windows, ("_i", "_w"), ("_j", "_e")), deal(events, ("_j", "_e"), ("_i", "_w"))


def interval_join(windows: DataFrame, events: DataFrame, key: str, first: str, last: str, day: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Inner join of windows and events of one key with ``first <= day <= last``.

    Both sides are also keyed by month: a window is repeated for each month it touches, an event has one
    month. That keeps the join an equi-join, spreads a busy customer over months and pairs a window only
    with events of its own months. A month of a customer with more than ``tile_rows`` rows on a side is dealt over tiles.
    """
    by_month, keyed = dealt(*_by_month(windows, events, first, last, day), key, tile_rows)
    joined = by_month.join(keyed, [key, "_month", "_i", "_j"])
    return joined.where(F.col(day).between(F.col(first), F.col(last))).drop("_month", "_i", "_j")
