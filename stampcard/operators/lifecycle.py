"""Lifecycle states from daily snapshots compared with the previous month end.

A state is an ordered list of (label, condition) rules folded into one CASE; a null condition is not true,
as in SQL. Detailed states are generated from the tier horizons instead of being spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stampcard.functions.dates import is_month_end, prev_month_end

# Months without activity after which a tier counts as lost, and look-ahead months per label.
HORIZONS = [(("ELITE", "PREMIUM"), 24), (("NORMAL", "FAN"), 12)]
LOOK_AHEAD = {"1M": 0, "2M": 1, "3M": 2, "6M": 5}
FUNNEL_GROUPS = {
    "NO_CANJEADOR_HISTORICO": ["NO_CANJEADOR_HISTORICO"],
    "FUGADOS": ["NO_CANJEADOR_FUNNEL", "EX_CANJEADOR_NO_PARTICIPANTE", "FUGADOS"],
    "NUEVO": ["NUEVO"],
    "RECUPERADO": ["RECUPERADO"],
    "RECURRENTE": ["RECURRENTE", "CANJEADOR_NO_PARTICIPANTE"],
}
UNKNOWN_STATE = "NO INFO"

_CLOSE_COLUMNS = ["loy_categoria", "flag_acumulador", "flag_canjeador_12_24m", "ultima_compra", "ultimo_canje"]
#: Carried from the close too, where the snapshots have them; no state depends on them.
_CARRIED = ["flag_pos_canje_12_24m", "ultima_fecha_pos_canje"]


def close_columns(snapshots: DataFrame) -> list[str]:
    return [*_CLOSE_COLUMNS, *[name for name in _CARRIED if name in snapshots.columns]]


def first_match(rules: list[tuple[str, Column]], otherwise: Column | None = None) -> Column:
    out = F
    for label, rule in rules:
        out = out.when(rule, F.lit(label))
    return out if otherwise is None else out.otherwise(otherwise)


def month_end_asof(daily: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each daily row with the customer's state at the previous month end (``*_cierre``, null if absent)."""
    closes = snapshots.where(is_month_end(F.col("partition_date"))).select(
        F.col("cust_id").alias("_close_cust"),
        F.col("partition_date").alias("partition_cierre"),
        *[F.col(name).alias(f"{name}_cierre") for name in close_columns(snapshots)],
    )
    same = (F.col("cust_id") == F.col("_close_cust")) & (prev_month_end(F.col("partition_date")) == F.col("partition_cierre"))
    return daily.join(closes, same, "left").drop("_close_cust")


def month_end_asof_few(daily: DataFrame, closes: DataFrame) -> DataFrame:
    """As ``month_end_asof`` for a few month ends: they come as one map per customer.

    The join is by customer alone, so rows already partitioned by customer stay where they are.
    """
    values = F.struct(*[F.col(name).alias(f"{name}_cierre") for name in close_columns(closes)])
    entries = F.collect_list(F.struct(F.col("partition_date").alias("day"), values.alias("state")))
    by_customer = closes.groupBy("cust_id").agg(F.map_from_entries(entries).alias("_closes"))
    day = prev_month_end(F.col("partition_date"))
    joined = daily.join(by_customer, "cust_id", "left").withColumn("_close", F.try_element_at("_closes", day))
    return joined.select(*daily.columns, F.when(F.col("_close").isNotNull(), day).alias("partition_cierre"), "_close.*")


def snapshots_from(snapshots: DataFrame, start) -> tuple[DataFrame, DataFrame]:
    """Daily rows from ``start`` on, and rows from the month end before it on (for the closes)."""
    day = F.col("partition_date")
    return snapshots.where(day >= F.lit(start)), snapshots.where(day >= prev_month_end(F.lit(start)))


def lifecycle_base(snapshots: DataFrame, start) -> DataFrame:
    daily, closes = snapshots_from(snapshots, start)
    return month_end_asof(daily, closes)


def _tier(suffix: str = "") -> Column:
    return F.upper(F.col(f"loy_categoria{suffix}"))


def _past_horizon(last: str, as_of: Column) -> Column:
    """Last activity lies on or before ``as_of`` minus the tier's horizon."""
    hits = [_tier().isin(*tiers) & (F.col(last) <= F.add_months(as_of, -months)) for tiers, months in HORIZONS]
    return hits[0] | hits[1]


def _at_risk(last: str, ahead: int) -> Column:
    """Will be past the horizon at the end of the month ``ahead`` months from now."""
    return _past_horizon(last, F.last_day(F.add_months("partition_date", ahead)))


def _downgraded(*last: str) -> Column:
    """Fell from a long-horizon tier to a short one and is idle for longer than the short horizon."""
    (long_tiers, _), (short_tiers, months) = HORIZONS
    limit = F.add_months("partition_date", -months)
    idle = F.col(last[0]) < limit
    for name in last[1:]:
        idle = idle | (F.col(name) < limit)
    return _tier("_cierre").isin(*long_tiers) & _tier().isin(*short_tiers) & idle


def _same_class(one_way_short: bool = False) -> Column:
    """Tier unchanged, or changed within its horizon class; optionally only NORMAL to FAN in the short class."""
    (long_tiers, _), (short_tiers, _) = HORIZONS
    before, now = _tier("_cierre"), _tier()
    if one_way_short:
        short = (before == short_tiers[0]) & (now == short_tiers[1])
    else:
        short = before.isin(*short_tiers) & now.isin(*short_tiers)
    return (before == now) | short | (before.isin(*long_tiers) & now.isin(*long_tiers))


def acumulador(base: DataFrame, detailed: bool = False) -> DataFrame:
    """Purchase lifecycle state ``tipo_acumulador`` (and its detailed form)."""
    now, before = F.col("flag_acumulador"), F.col("flag_acumulador_cierre")
    bought, bought_before = F.col("ultima_compra"), F.col("ultima_compra_cierre")
    no_close = F.col("partition_cierre").isNull() & F.col("partition_date").isNotNull()
    rules = [
        (
            "NUEVO",
            ((before == 0) & bought_before.isNull() & (now == 1) & bought.isNotNull())
            | ((now == 1) & no_close & before.isNull()),
        ),
        ("RECUPERADO", bought_before.isNotNull() & (before == 0) & (now == 1)),
        ("FUGADOS", (before == 1) & (now == 0)),
        ("NO_PARTICIPANTE_HISTORICO", bought.isNull()),
        ("NO_PARTICIPANTE_ACTUAL", (before == 0) & (now == 0) & bought.isNotNull()),
        ("RECURRENTE", (now == 1) & (before == 1) & bought.isNotNull()),
    ]
    out = base.withColumn("tipo_acumulador", first_match(rules))
    if not detailed:
        return out
    state = F.col("tipo_acumulador")
    fine = [
        (f"POSIBLES_FUGADOS_{label}", (state == "RECURRENTE") & _at_risk("ultima_compra", ahead))
        for label, ahead in LOOK_AHEAD.items()
    ]
    fine += [
        ("FUGADO_POR_CATEGORIA", (state == "FUGADOS") & _downgraded("ultima_compra")),
        ("FUGADO_POR_COMPRA", (state == "FUGADOS") & _same_class()),
    ]
    return out.withColumn("tipo_acumulador_detallado", first_match(fine, state))


def canjeador(base: DataFrame, detailed: bool = False) -> DataFrame:
    """Redemption lifecycle state ``tipo_canjeador`` (and its detailed form)."""
    buys, bought_before = F.col("flag_acumulador"), F.col("flag_acumulador_cierre")
    redeems, redeemed_before = F.col("flag_canjeador_12_24m"), F.col("flag_canjeador_12_24m_cierre")
    last, last_before = F.col("ultimo_canje"), F.col("ultimo_canje_cierre")
    no_close = F.col("partition_cierre").isNull() & F.col("partition_date").isNotNull()
    active_before = (bought_before == 1) & (redeemed_before == 1)
    rules = [
        (
            "NUEVO",
            (
                ((bought_before == 0) | ((redeemed_before == 0) & last_before.isNull()))
                & ((buys == 1) & (redeems == 1) & last.isNotNull())
            )
            | ((buys == 1) & no_close & (redeems == 1) & redeemed_before.isNull()),
        ),
        (
            "RECUPERADO",
            F.col("ultima_compra_cierre").isNotNull() & last_before.isNotNull()
            & (redeemed_before == 0) & (redeems == 1) & (buys == 1),
        ),
        ("FUGADOS", (active_before & (buys == 0)) | (active_before & (redeems == 0))),
        ("NO_CANJEADOR_HISTORICO", last.isNull()),
        ("NO_CANJEADOR_FUNNEL", (redeemed_before == 0) & (redeems == 0) & last.isNotNull()),
        ("CANJEADOR_NO_PARTICIPANTE", (buys == 0) & (redeems == 1)),
        ("EX_CANJEADOR_NO_PARTICIPANTE", (bought_before == 0) & (redeemed_before == 1) & (redeems == 0)),
        (
            "RECURRENTE",
            (buys == 1) & active_before & (redeems == 1) & last.isNotNull() & F.col("ultima_compra").isNotNull(),
        ),
    ]
    out = base.withColumn("tipo_canjeador", first_match(rules))
    if not detailed:
        return out
    state = F.col("tipo_canjeador")
    activities = {"COMPRA": "ultima_compra", "CANJE": "ultimo_canje"}
    fine = [
        (f"POSIBLES_FUGADOS_{kind}_{label}", (state == "RECURRENTE") & _at_risk(column, ahead))
        for label, ahead in LOOK_AHEAD.items()
        for kind, column in activities.items()
    ]
    lost, today = state == "FUGADOS", F.col("partition_date")
    fine += [
        ("FUGADO_POR_CATEGORIA", lost & _downgraded("ultima_compra", "ultimo_canje")),
        ("FUGADO_POR_CANJE", lost & _same_class(one_way_short=True) & _past_horizon("ultimo_canje", today)),
        ("FUGADO_POR_COMPRA", lost & _same_class() & _past_horizon("ultima_compra", today)),
    ]
    return out.withColumn("tipo_canjeador_detallado", first_match(fine, state))


def funnel_group(state: Column) -> Column:
    """Report group of a redemption state; unknown or missing states get their own label."""
    return first_match([(g, state.isin(states)) for g, states in FUNNEL_GROUPS.items()], F.lit(UNKNOWN_STATE))


def states_on(snapshots: DataFrame, days: DataFrame, start, customers: DataFrame | None = None) -> DataFrame:
    """Redemption state on the given days only, of all or of the given customers.

    ``days`` has one ``partition_date`` per calendar day asked for, so it is at most a few thousand rows and
    prunes the snapshot partitions. ``customers`` (distinct ``cust_id``) leaves other customers out before anything
    else, and the partitioning by customer that this takes serves the month-end join and later groupings too.
    """
    daily, closes = snapshots_from(snapshots, start)
    wanted = daily.join(F.broadcast(days), "partition_date", "left_semi")
    close_days = days.select(prev_month_end(F.col("partition_date")).alias("partition_date")).distinct()
    closes = closes.join(F.broadcast(close_days), "partition_date", "left_semi")
    if customers is not None:
        wanted = wanted.join(customers, "cust_id", "left_semi")
        closes = closes.join(customers, "cust_id", "left_semi")
    return canjeador(month_end_asof_few(wanted, closes)).select("partition_date", "cust_id", "tipo_canjeador")


def customer_states(states: DataFrame) -> DataFrame:
    """Known states by day, one row per customer; at most one entry per day asked for.

    A customer has one snapshot per day; a second one fails the job instead of doubling its sends.
    """
    known = states.where(F.col("tipo_canjeador").isNotNull())
    entries = F.collect_list(F.struct("partition_date", "tipo_canjeador"))
    return known.groupBy("cust_id").agg(F.map_from_entries(entries).alias("states"))


def state_at(sends: DataFrame, states: DataFrame, lookups: dict[str, str], customer: str = "rut") -> DataFrame:
    """Add the state on each date column of ``lookups`` (date column to output name), null where unknown.

    All lookups share one join by customer.
    """
    by_customer = customer_states(states).withColumnRenamed("cust_id", customer)
    found = {out: F.try_element_at("states", F.col(on_date)) for on_date, out in lookups.items()}
    return sends.join(by_customer, customer, "left").withColumns(found).drop("states")


def needed_states(states: DataFrame, sends: DataFrame, on_date: str, customer: str = "rut") -> DataFrame:
    """Keep the (customer, day) pairs that the sends ask for."""
    pairs = sends.select(F.col(customer).alias("cust_id"), F.col(on_date).alias("partition_date"))
    return states.join(pairs, ["cust_id", "partition_date"], "left_semi")
