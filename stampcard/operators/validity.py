"""States as validity intervals: one row per change of a customer instead of one per snapshot.

Days are numbered by the calendar of the snapshots, so an interval never covers a day on which the customer had no
snapshot, and a day outside the calendar has no state. Rows without a customer have no history and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stampcard.functions.dates import prev_month_end
from stampcard.operators.lifecycle import close_columns


def snapshot_calendar(snapshots: DataFrame, day: str = "partition_date") -> DataFrame:
    """``day, pos``: the days that have snapshots, numbered in order. Gathered in one row, as there is one entry per calendar day."""
    days = snapshots.where(F.col(day).isNotNull()).select(F.col(day).alias("day")).distinct()
    return days.agg(F.array_sort(F.collect_list("day")).alias("days")).select(F.posexplode("days").alias("pos", "day")).select("day", "pos")


def state_intervals(snapshots: DataFrame, calendar: DataFrame, customer: str = "cust_id", day: str = "partition_date") -> DataFrame:
    """Runs of equal states on consecutive days of the calendar: ``customer, first_pos, last_pos, valid_from, valid_to`` and the state's columns.

    A customer has one snapshot per day; window and grouping share one partitioning by customer.
    """
    values = [c for c in snapshots.columns if c not in (customer, day)]
    placed = snapshots.where(F.col(customer).isNotNull()).join(calendar.withColumnRenamed("day", day), day)
    order = Window.partitionBy(customer).orderBy("pos")
    state = F.struct(*values)
    goes_on = (F.lag("pos").over(order) == F.col("pos") - 1) & F.lag(state).over(order).eqNullSafe(state)
    marked = placed.withColumn("_starts", F.when(goes_on, 0).otherwise(1))
    run = F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    grouped = marked.withColumn("_run", run).groupBy(customer, "_run")
    return grouped.agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min(day).alias("valid_from"), F.max(day).alias("valid_to"),
        *[F.first(c).alias(c) for c in values],
    ).drop("_run")


def daily_states(intervals: DataFrame, calendar: DataFrame, day: str = "partition_date") -> DataFrame:
    """The snapshots that the intervals stand for."""
    each = intervals.withColumn("pos", F.explode(F.sequence("first_pos", "last_pos"))).join(calendar.withColumnRenamed("day", day), "pos")
    return each.drop("pos", "first_pos", "last_pos", "valid_from", "valid_to")


def _history(intervals: DataFrame, customer: str, values: list[str], out: str) -> DataFrame:
    """One row per customer; it has at most one entry per day of the calendar."""
    entry = F.struct("first_pos", "last_pos", "valid_from", *values)
    return intervals.groupBy(F.col("cust_id").alias(customer)).agg(F.array_sort(F.collect_list(entry)).alias(out))


def _covering(entries: Column, pos: Column) -> Column:
    return F.get(F.filter(entries, lambda e: (e["first_pos"] <= pos) & (pos <= e["last_pos"])), F.lit(0))


def _numbered(rows: DataFrame, calendar: DataFrame, day: Column, out: str) -> DataFrame:
    at = calendar.select(F.col("day").alias("_day"), F.col("pos").alias(out))
    return rows.join(at, day == F.col("_day"), "left").drop("_day")


def state_on(rows: DataFrame, intervals: DataFrame, calendar: DataFrame, lookups: dict[str, tuple[str, str]], customer: str = "cust_id") -> DataFrame:
    """``rows`` with the state on given days: ``lookups`` maps an output column to (date column, state column).

    Null where the day has no snapshot of the customer. All lookups share one join by customer.
    """
    values = list(dict.fromkeys(value for _, value in lookups.values()))
    dates = list(dict.fromkeys(on for on, _ in lookups.values()))
    joined = rows
    for i, on in enumerate(dates):
        joined = _numbered(joined, calendar, F.col(on), f"_pos{i}")
    joined = joined.join(_history(intervals, customer, values, "_history"), customer, "left")
    found = {out: _covering(F.col("_history"), F.col(f"_pos{dates.index(on)}"))[value] for out, (on, value) in lookups.items()}
    return joined.withColumns(found).select(*rows.columns, *found)


def last_state(rows: DataFrame, intervals: DataFrame, on: str, value: str, out: str, customer: str = "cust_id") -> DataFrame:
    """``rows`` with the state of the customer's last snapshot on or before a day, however old; null if there is none."""
    joined = rows.join(_history(intervals, customer, [value], "_history"), customer, "left")
    known = F.element_at(F.filter("_history", lambda e: e["valid_from"] <= F.col(on)), -1)
    return joined.withColumn(out, F.when(F.exists("_history", lambda e: e["valid_from"] <= F.col(on)), known[value])).select(*rows.columns, out)


def month_end_asof(intervals: DataFrame, calendar: DataFrame, start) -> DataFrame:
    """As ``lifecycle.lifecycle_base``, from intervals: every day from ``start`` on with the state at the month end before it."""
    values = close_columns(intervals)
    days = calendar.where(F.col("day") >= F.lit(start))
    daily = daily_states(intervals, days)
    asked = _numbered(daily, calendar, prev_month_end(F.col("partition_date")), "_pos")
    joined = asked.join(_history(intervals, "cust_id", values, "_history"), "cust_id", "left").withColumn("_close", _covering(F.col("_history"), F.col("_pos")))
    closes = [F.col("_close")[value].alias(f"{value}_cierre") for value in values]
    return joined.select(*daily.columns, F.when(F.col("_close").isNotNull(), prev_month_end(F.col("partition_date"))).alias("partition_cierre"), *closes)


def form_sizes(snapshots: DataFrame, intervals: DataFrame) -> DataFrame:
    """``n_snapshots, n_intervals``: rows of both forms."""
    rows = snapshots.where("cust_id IS NOT NULL").select(F.lit(1).alias("snapshot")).unionByName(intervals.select(F.lit(0).alias("snapshot")))
    return rows.agg(F.count_if(F.col("snapshot") == 1).alias("n_snapshots"), F.count_if(F.col("snapshot") == 0).alias("n_intervals"))
