"""Fixed-shape pivots and matrices. Pivot values are always listed, so no extra pass looks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stampcard.functions.ratios import band_pivot, spct
from stampcard.functions.text import FUNNEL_LABELS, FUNNEL_ORDER, label_of, position_in
from stampcard.operators.lifecycle import UNKNOWN_STATE
from stampcard.operators.metrics import KNOWN_REDEEMER, NEW_REDEEMER, exact_sum
from stampcard.operators.reports import clients_where
from stampcard.operators.rfm import RFM_ORDER

# Axes of the segment pivot and its metric rows, order of the funnel table.
CLIENT_TYPES = ["BANCO", "OMP"]
HISTORY = {"HIST": KNOWN_REDEEMER, "NOHIST": NEW_REDEEMER}
GROUPS = ["GM", "GC"]
PIVOT_METRICS = ["clients", "redeemers", "no_history", "new", "redeem_pct", "points", "value"]
FUNNEL_TABLE_ORDER = ["RECURRENTE", "RECUPERADO", "NUEVO", "FUGADOS", "NO_CANJEADOR_HISTORICO"]


def segment_cells(metrics: DataFrame, value_per_point: float = 0.01) -> DataFrame:
    """Seven metrics per campaign and (client type, history, group) cell."""
    redeemed = F.col("FLAG_CANJE") == "CANJEO"
    kept = metrics.where(
        F.col("GMGC").isin(GROUPS) & F.col("TIPO_CLIENTE").isin(CLIENT_TYPES) & F.col("TIPO").isin(list(HISTORY.values()))
    )
    code = F.when(F.col("TIPO") == KNOWN_REDEEMER, "HIST").otherwise("NOHIST")
    cell = F.concat_ws("_", "TIPO_CLIENTE", code, "GMGC").alias("cell")
    sums = kept.groupBy(F.col("NOMBRE_CAMPANHA").alias("campaign"), cell).agg(
        F.sum("CLIENTES").cast("double").alias("clients"),
        clients_where(redeemed).cast("double").alias("redeemers"),
        clients_where(F.col("TIPO") == NEW_REDEEMER).cast("double").alias("no_history"),
        clients_where(F.col("GRUPO_CANJE_POST") == "NUEVO").cast("double").alias("new"),
        F.coalesce(exact_sum(F.col("PUNTOS_CANJEADOS")), F.lit(0)).cast("double").alias("points"),
    )
    return sums.withColumns(
        {
            "redeem_pct": spct(F.col("redeemers"), F.col("clients")),
            "value": F.round(F.col("points") * value_per_point, 2),
        }
    )


def segment_pivot(metrics: DataFrame, value_per_point: float = 0.01) -> DataFrame:
    """Metrics as rows, the eight cells as columns, zeros in empty cells."""
    columns = [f"{c}_{h}_{g}" for c in CLIENT_TYPES for h in HISTORY for g in GROUPS]
    cells = segment_cells(metrics, value_per_point)
    long = cells.unpivot(["campaign", "cell"], PIVOT_METRICS, "metric", "amount")
    campaigns = metrics.select(F.col("NOMBRE_CAMPANHA").alias("campaign")).distinct()
    grid = campaigns.select("campaign", F.explode(F.array(*[F.lit(m) for m in PIVOT_METRICS])).alias("metric"))
    wide = long.groupBy("campaign", "metric").pivot("cell", columns).agg(F.sum("amount"))
    return grid.join(wide, ["campaign", "metric"], "left").fillna(0.0, columns)


def pivot_bands(metrics: DataFrame) -> DataFrame:
    cells = segment_cells(metrics)
    return cells.select("campaign", "cell", "redeem_pct", band_pivot(F.col("redeem_pct")).alias("band"))


def funnel_table(metrics: DataFrame) -> DataFrame:
    """Clients and redeemers per prior state and group; empty pairs are left out."""
    pre = F.col("GRUPO_CANJE_PRE")
    kept = metrics.where(pre.isin(FUNNEL_TABLE_ORDER) & F.col("GMGC").isin(GROUPS))
    totals = kept.groupBy(F.col("NOMBRE_CAMPANHA").alias("campaign"), pre, "GMGC").agg(
        F.sum("CLIENTES").alias("clients"), clients_where(F.col("FLAG_CANJE") == "CANJEO").alias("redeemers")
    )
    return totals.select(
        "campaign", label_of(pre, FUNNEL_LABELS).alias("state"), "GMGC", "clients", "redeemers",
        spct(F.col("redeemers"), F.col("clients")).alias("pct"),
    ).orderBy("campaign", position_in(pre, FUNNEL_TABLE_ORDER), F.col("GMGC").desc())


def transition_matrix(metrics: DataFrame, active_only: bool = False, all_states: bool = True) -> DataFrame:
    """Treated clients by prior state (rows) and later state (columns), zeros where nobody moved.

    Columns are the funnel states plus the unknown state, so rows add up to the treated base. With
    ``all_states=False`` a campaign whose unknown state occurs only afterwards shows zero there.
    ``active_only`` leaves out customers who had never redeemed.
    """
    columns = [*FUNNEL_ORDER, UNKNOWN_STATE]
    treated = metrics.where(F.col("GMGC") == "GM").select(
        F.col("NOMBRE_CAMPANHA").alias("campaign"), F.col("GRUPO_CANJE_PRE").alias("pre"),
        F.col("GRUPO_CANJE_POST").alias("post"), "CLIENTES",
    )
    wide = treated.groupBy("campaign", "pre").pivot("post", columns).agg(F.sum("CLIENTES")).fillna(0, columns)
    if not all_states:
        seen = treated.groupBy("campaign").agg(F.bool_or(F.col("pre") == UNKNOWN_STATE).alias("_seen"))
        shown = F.when(F.col("_seen"), F.col(f"`{UNKNOWN_STATE}`")).otherwise(F.lit(0))
        wide = wide.join(seen, "campaign").withColumn(UNKNOWN_STATE, shown).drop("_seen")
    if active_only:
        wide = wide.where(F.col("pre") != "NO_CANJEADOR_HISTORICO")
    named = [F.col(f"`{state}`").alias("to_" + state.lower().replace(" ", "_")) for state in columns]
    return wide.select("campaign", "pre", *named).orderBy("campaign", position_in(F.col("pre"), FUNNEL_ORDER))


def tier_segment(rfm: DataFrame) -> DataFrame:
    """Customers by tier and segment; unknown tiers are left out."""
    wide = rfm.dropna(subset=["tier"]).groupBy("tier").pivot("rfm_segment", RFM_ORDER).count().fillna(0, RFM_ORDER)
    return wide.select("tier", *[F.col(f"`{s}`").alias(s.lower().replace(" ", "_")) for s in RFM_ORDER])
