"""States as intervals, interval joins of busy customers, and customer bitmaps, against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stampcard.operators import distinct, intervals, validity

D = dt.date
SNAPSHOTS = "partition_date DATE, cust_id INT, tier STRING, flag INT"


def history():
    """Irregular days; customers come late, miss days, change back and forth, hold nulls; one id is null."""
    rng = random.Random(5)
    days = sorted({D(2000, 1, 1) + dt.timedelta(days=rng.randrange(200)) for _ in range(30)})
    rows = []
    for cust in range(25):
        tier = "A"
        for day in days[cust % 7 :]:
            if rng.random() < 0.2:
                tier = rng.choice(["A", "B", None])
            if rng.random() < 0.9:
                rows.append((day, cust, tier, None if cust % 5 == 0 else int(day.month > 3)))
    return days, rows + [(days[0], None, "A", 1)]


def plain_intervals(days, rows):
    state = {(c, d): (t, f) for d, c, t, f in rows}
    out = []
    for cust in {c for _, c, _, _ in rows if c is not None}:
        for i, day in enumerate(days):
            now = state.get((cust, day))
            if now is None:
                continue
            if i and state.get((cust, days[i - 1])) == now:
                out[-1] = (*out[-1][:2], day, *now)
            else:
                out.append((cust, day, day, *now))
    return sorted(out, key=repr)


def test_intervals_and_lookups(spark):
    days, rows = history()
    snapshots = spark.createDataFrame(rows, SNAPSHOTS)
    calendar = validity.snapshot_calendar(snapshots).cache()
    made = validity.state_intervals(snapshots, calendar).cache()
    got = sorted((tuple(r) for r in made.select("cust_id", "valid_from", "valid_to", "tier", "flag").collect()), key=repr)
    assert got == plain_intervals(days, rows) and len(got) < len(rows)
    kept = [r for r in rows if r[1] is not None]
    back = validity.daily_states(made, calendar).select("partition_date", "cust_id", "tier", "flag").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(kept, key=repr)
    sizes = validity.form_sizes(snapshots, made).first()
    assert (sizes.n_snapshots, sizes.n_intervals) == (len(kept), len(got))

    state = {(c, d): t for d, c, t, _ in kept}
    asked = [(c, days[0] + dt.timedelta(days=k)) for c in (*range(26), None) for k in range(-3, 215, 4)] + [(3, None)]
    frame = spark.createDataFrame(asked, "cust_id INT, on_day DATE")
    on = validity.state_on(frame, made, calendar, {"tier": ("on_day", "tier")}).collect()
    assert sorted(map(tuple, on), key=repr) == sorted(((c, d, state.get((c, d))) for c, d in asked), key=repr)

    def latest(cust, day):
        known = [d for c, d in state if c == cust and day is not None and d <= day]
        return state[cust, max(known)] if known else None

    last = validity.last_state(frame, made, "on_day", "tier", "tier").collect()
    assert sorted(map(tuple, last), key=repr) == sorted(((c, d, latest(c, d)) for c, d in asked), key=repr)


def test_no_snapshots(spark):
    snapshots = spark.createDataFrame([], SNAPSHOTS)
    calendar = validity.snapshot_calendar(snapshots)
    made = validity.state_intervals(snapshots, calendar)
    frame = spark.createDataFrame([(1, D(2000, 1, 1))], "cust_id INT, on_day DATE")
    assert [tuple(r) for r in validity.state_on(frame, made, calendar, {"tier": ("on_day", "tier")}).collect()] == [(1, D(2000, 1, 1), None)]
    assert tuple(validity.form_sizes(snapshots, made).first()) == (0, 0)


def test_busy_customer_is_dealt_over_tiles(spark):
    """One customer has a third of the windows and events, nearly all in one month."""
    day = lambda i: D(2000, 3, 1) + dt.timedelta(days=i % 30)
    windows = [(0 if i % 3 == 0 else i, i, day(i), day(i) + dt.timedelta(days=i % 9)) for i in range(900)]
    events = [(0 if i % 3 == 0 else i, i, day(i * 7)) for i in range(1500)] + [(0, -1, day(4))] * 5 + [(None, 7, day(2))] * 20
    left, right = spark.createDataFrame(windows, "k INT, w INT, a DATE, b DATE"), spark.createDataFrame(events, "k INT, e INT, d DATE")
    got = intervals.interval_join(left, right, "k", "a", "b", "d", tile_rows=50)
    by_key = {}
    for k, e, d in events:
        by_key.setdefault(k, []).append((e, d))
    want = sorted((k, w, e) for k, w, a, b in windows for e, d in by_key.get(k, []) if a <= d <= b)
    assert sorted(tuple(r) for r in got.select("k", "w", "e").collect()) == want

    sides = intervals.dealt(*intervals._by_month(left, right, "a", "b", "d"), "k", 50)
    for side in sides:
        largest = side.where("k IS NOT NULL").groupBy("k", "_month", "_i", "_j").count().agg(F.max("count")).first()[0]
        assert largest <= 100, "twice an even share of the tile"
    assert intervals.busy_months(*intervals._by_month(left, right, "a", "b", "d"), "k", 50).count() <= 2


def test_bitmaps_roll_up_like_distinct_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.choice([None, rng.randrange(70_000), rng.randrange(70_000)])) for _ in range(120_000)] + [("c", "x", None)]
    frame = spark.createDataFrame(rows, "g STRING, channel STRING, cust INT").cache()
    codes = distinct.customer_codes(frame, "cust")
    maps = distinct.customer_bitmaps(frame, ["g", "channel"], "cust", codes).cache()
    assert maps.agg(F.max("bucket")).first()[0] >= 2
    for keys in (["g", "channel"], ["g"], ["channel"], []):
        want = frame.groupBy(*keys).agg(F.countDistinct("cust").alias("n")).collect()
        got = distinct.customers_by(maps, keys, "n").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    half = frame.where("cust % 3 < 2 OR cust IS NULL"), frame.where("cust % 3 > 0")
    parts = [distinct.customer_bitmaps(part, ["g", "channel"], "cust", codes) for part in half]
    both = distinct.united(parts[0].unionByName(parts[1]), ["g", "channel"])
    assert sorted(map(tuple, distinct.customers_by(both, ["g"], "n").collect())) == sorted(map(tuple, distinct.customers_by(maps, ["g"], "n").collect()))


def test_customer_without_a_code_fails(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2)], "g STRING, cust INT")
    codes = distinct.customer_codes(frame.where("cust = 1"), "cust")
    with pytest.raises(PySparkException, match="without a code"):
        distinct.customer_bitmaps(frame, ["g"], "cust", codes).collect()
