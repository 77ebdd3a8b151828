"""The campaign metrics cube: clients, redemptions and points per send, group and lifecycle state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from stampcard.operators.features import not_returned
from stampcard.operators.identity import identity_rows, measurement_identity
from stampcard.operators.lifecycle import funnel_group, state_at, states_on
from stampcard.session import materialize

# Labels of the cube.
NO_CHANNEL_LABEL = "NO CANJE"
KNOWN_REDEEMER, NEW_REDEEMER = "CANJEADOR HISTORICO", "NO CANJEADOR HISTORICO"
CUBE_KEYS = [
    "FECHA_ENVIO", "NOMBRE_CAMPANHA", "TIPO_CLIENTE", "CANAL_CANJE", "GMGC", "FLAG_CANJE", "TIPO", "GRUPO_CANJE_PRE",
    "GRUPO_CANJE_POST",
]


def redeemer_history(first: Column, send_date: Column) -> Column:
    """First redemption before the send or not; no redemption at all counts as not."""
    return F.when(first < send_date, KNOWN_REDEEMER).otherwise(NEW_REDEEMER)


def customer_redemptions(rdm: DataFrame, start: dt.date, end: dt.date, customers: DataFrame | None = None) -> DataFrame:
    """First redemption ever and the daily redemptions of [start, end], one row per customer (of ``customers``, if given).

    Redemptions shrink to one entry per day and channel of the range before they are gathered, so a list is bounded by
    the days of the range times the few channels, however many redemptions a customer has. All others of a customer fold
    into one row before the shuffle; only their first date matters.
    """
    in_range = F.col("redemption_date").between(F.lit(start), F.lit(end))
    kept = rdm.where(not_returned())
    if customers is not None:
        kept = kept.join(customers, "cust_id", "left_semi")
    daily = kept.groupBy(
        "cust_id", F.when(in_range, F.col("redemption_date")).alias("day"), F.when(in_range, F.col("bu_channel_name")).alias("bu_channel_name")
    ).agg(
        F.min("redemption_date").alias("first"), F.count("redemption_id_unico").alias("canjes"), F.sum("redemption_points_amt").alias("puntos")
    )
    entry = F.struct(F.col("day").alias("redemption_date"), "bu_channel_name", "canjes", "puntos")
    return daily.groupBy("cust_id").agg(
        F.min("first").alias("primer_canje"), F.collect_list(F.when(F.col("day").isNotNull(), entry)).alias("entries")
    )


def send_days(sends: DataFrame) -> DataFrame:
    """Distinct window start and end days; calendar-sized."""
    days = F.explode(F.array("inicio_vigencia", "fin_vigencia")).alias("partition_date")
    return sends.select(days).distinct()


def cube_rows(sends: DataFrame, rdm: DataFrame, snapshots: DataFrame, mail: DataFrame, jobs: DataFrame,
              start: dt.date, end: dt.date, dedupe: bool = False) -> DataFrame:
    """Rows of the cube before they are counted: its keys, ``rut_medicion``, ``canjes`` and ``puntos`` of one day and channel.

    Redemptions and states come as one row per customer, so both joins share one partitioning by customer and no send is
    paired with single events.
    """
    ranged = sends.where(F.col("fecha_envio").between(F.lit(start), F.lit(end)))
    identify = measurement_identity if dedupe else identity_rows
    rows = identify(ranged, mail, jobs, start, end, *([True] if dedupe else []))
    asked = ranged.select(F.col("rut").alias("cust_id")).distinct()
    redeemed = customer_redemptions(rdm, start, end, asked).withColumnRenamed("cust_id", "rut_medicion")
    states = states_on(snapshots, send_days(ranged), start, asked)

    looked_up = {"inicio_vigencia": "state_pre", "fin_vigencia": "state_post"}
    joined = state_at(rows.join(redeemed, "rut_medicion", "left"), states, looked_up, "rut_medicion")
    in_window = F.filter("entries", lambda e: e["redemption_date"].between(F.col("inicio_vigencia"), F.col("fin_vigencia")))
    rows = joined.select(
        "fecha_envio", "nombre_campanha", "tipo_cliente", "gmgc", "rut_medicion", "weight", "primer_canje", "state_pre",
        "state_post", F.explode_outer(in_window).alias("hit"),
    )
    return rows.select(
        F.col("fecha_envio").alias("FECHA_ENVIO"),
        F.col("nombre_campanha").alias("NOMBRE_CAMPANHA"),
        F.col("tipo_cliente").alias("TIPO_CLIENTE"),
        F.coalesce("hit.bu_channel_name", F.lit(NO_CHANNEL_LABEL)).alias("CANAL_CANJE"),
        F.col("gmgc").alias("GMGC"),
        F.when(F.col("hit").isNotNull(), "CANJEO").otherwise("NO CANJEO").alias("FLAG_CANJE"),
        redeemer_history(F.col("primer_canje"), F.col("fecha_envio")).alias("TIPO"),
        funnel_group(F.col("state_pre")).alias("GRUPO_CANJE_PRE"),
        funnel_group(F.col("state_post")).alias("GRUPO_CANJE_POST"),
        "rut_medicion",
        (F.col("hit.canjes") * F.col("weight")).alias("canjes"),
        (F.col("hit.puntos") * F.col("weight")).alias("puntos"),
    )


def campaign_redemption_metrics(sends: DataFrame, rdm: DataFrame, snapshots: DataFrame, mail: DataFrame,
                                jobs: DataFrame, start: dt.date, end: dt.date, dedupe: bool = False) -> DataFrame:
    """Metrics cube of the sends in [start, end].

    Sums carry the fan-out weight of the identity match and a customer with two channels counts once in each, as
    in a row-by-row match; ``dedupe=True`` leaves the fan-out out of the sums.
    """
    return counted_cells(customer_cells(cube_rows(sends, rdm, snapshots, mail, jobs, start, end, dedupe)))


def customer_cells(rows: DataFrame) -> DataFrame:
    """``rows`` of the cube with one row for each cell and customer."""
    return rows.groupBy(*CUBE_KEYS, "rut_medicion").agg(F.sum("canjes").alias("canjes"), F.sum("puntos").alias("puntos"))


def counted_cells(cells: DataFrame) -> DataFrame:
    """The cube from its ``customer_cells``; a customer is in a cell once, so counting rows counts customers.

    The weights of an address grow with the square of the sends that share it, so the sum over a cell's customers can pass 2^63.
    """
    sums = cells.groupBy(*CUBE_KEYS).agg(
        F.count("rut_medicion").alias("CLIENTES"),
        exact_sum(F.col("canjes")).alias("CANJES"),
        F.abs(exact_sum(F.col("puntos"))).alias("PUNTOS_CANJEADOS"),
    )
    return narrowed(materialize(sums, "cube-sums"), "CANJES", "PUNTOS_CANJEADOS")


def exact_sum(values: Column) -> Column:
    """Sum of whole numbers as a decimal, which no sum of BIGINT values can pass."""
    return F.sum(values.cast("decimal(28,0)"))


def narrowed(sums: DataFrame, *columns: str) -> DataFrame:
    """Decimal sums as BIGINT, the type of the contract; a column with a value that BIGINT can't hold stays decimal.

    Reads ``sums``, which should be stored.
    """
    greatest = sums.agg(*[F.max(F.abs(name)).alias(name) for name in columns]).first()
    return sums.withColumns({name: F.col(name).cast("bigint") for name in columns if (greatest[name] or 0) < 2**63})


def rfm_campaigns(scored: DataFrame) -> DataFrame:
    """Customers per campaign, group, segment and outcome; rows with an unknown key are left out."""
    keys = ["NOMBRE_CAMPANHA", "FECHA_ENVIO", "GMGC", "rfm_segment", "FLAG_CANJE"]
    return scored.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("CLIENTES"))


def score_attributed(attributed: DataFrame, rfm: DataFrame, missing_label: str) -> DataFrame:
    """Attributed sends with segment, scores and propensity; customers without a score get a label."""
    scores = rfm.select("cust_id", "rfm_segment", "r_score", "f_score", "m_score", "propensity_score")
    return attributed.join(scores, "cust_id", "left").select(
        F.col("fecha_envio").alias("FECHA_ENVIO"),
        F.col("nombre_campanha").alias("NOMBRE_CAMPANHA"),
        F.col("gmgc").alias("GMGC"),
        "cust_id",
        F.col("flag_canje").alias("FLAG_CANJE"),
        F.coalesce("rfm_segment", F.lit(missing_label)).alias("rfm_segment"),
        "r_score", "f_score", "m_score", "propensity_score",
    )
