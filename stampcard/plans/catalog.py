"""Runnable queries over the benchmark tables, one per operator or group of operators.

Each entry names the inventory ids it proves. Entities come lazily from the tables; report queries read the
stored cubes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from stampcard.fixtures import CHANNELS, END, SPEND, START, T0
from stampcard.functions import dates, ratios, text
from stampcard.operators import (
    attribution, distinct, encoding, evaluation, features, identity, intervals, lifecycle, metrics, model, pivots, planning, ranking, reports,
    rfm, validity,
)
from stampcard.plans import jobs
from stampcard.plans.marts import Marts
from stampcard.session import scratch_path
from stampcard.sources import filters, scans, sinks

QUERIES: dict[str, Callable[[Marts], DataFrame]] = {}
COVERS: dict[str, str] = {}

PRIOR_RATIO = 0.25
VALUE_PER_POINT = 0.01


def query(name: str, covers: str):
    def register(build: Callable[[Marts], DataFrame]):
        QUERIES[name] = build
        COVERS[name] = covers
        return build

    return register


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, build=build: build(Marts(spark, sf_dir).spread())) for name, build in QUERIES.items()}


# --- sources and sinks -------------------------------------------------------------------------


@query("a1_range_scan", "A1 B5")
def _(m):
    return scans.scan_range(m.metrics(), "FECHA_ENVIO", dt.date(2000, 3, 1), dt.date(2000, 9, 30))


@query("a2_email_scan", "A2")
def _(m):
    return scans.scan_range(m.email(), "inicio_vigencia", dt.date(2000, 2, 5), dt.date(2000, 11, 30), scans.EMAIL_COLUMNS)


@query("a3_projected_scan", "A3")
def _(m):
    return scans.scan_range(m.sends(), "fecha_envio", START, END, scans.SEND_COLUMNS)


@query("a4_snapshot_scan", "A4 G8")
def _(m):
    return scans.snapshot_at_last_close(m.snapshots(), dt.date(2000, 8, 15))


@query("a5_tolerant_read", "A5")
def _(m):
    return scans.select_present(m.rfm(), ["cust_id", "tier", "not_there", "rfm_segment", "tier", "propensity_score"])


@query("a6_campaign_read", "A6 A8")
def _(m):
    path = scratch_path(m.spark, "individual")
    sinks.write_individual(m.attributed(), path)
    columns = ["cust_id", "GMGC", "rfm_segment", "canjeo", F.col("propensity_score").cast("double").alias("score")]
    return scans.read_campaign(m.spark, path, "Camp Nro 3_05032000").select(
        *columns[:4], F.round(columns[4], 4).alias("score")
    )


@query("a7_parquet_round_trip", "A7")
def _(m):
    path = scratch_path(m.spark, "round-trip")
    sinks.write_parquet(m.rfm_cube(), path)
    return m.spark.read.parquet(path)


@query("a8_individual_dataset", "A8")
def _(m):
    path = scratch_path(m.spark, "individual")
    sinks.write_individual(m.attributed(), path)
    return m.spark.read.parquet(path).groupBy("NOMBRE_CAMPANHA", "GMGC").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("canjeo").alias("redeemers"), F.round(F.avg("propensity_score"), 4).alias("mean_score")
    )


@query("a9_metrics_backfill", "A9")
def _(m):
    path = scratch_path(m.spark, "metrics")
    cube = m.metrics()
    sinks.write_metrics(cube, path)
    # the backfill from June on finds no sends on the last day any more: that day goes, the days before June stay
    first, last = dt.date(2000, 6, 1), cube.agg(F.max("FECHA_ENVIO")).scalar()
    again = cube.where(F.col("FECHA_ENVIO") >= F.lit(first)).where(F.col("FECHA_ENVIO") < last)
    sinks.write_metrics(again, path, (first, END))
    return scans.read_dates(m.spark, path, cube.schema)


@query("a10_csv_export", "A10 B17")
def _(m):
    path = scratch_path(m.spark, "export")
    sinks.write_csv(filters.slice_campaign(m.metrics(), dt.date(2000, 4, 5), "Camp Nro 4_05042000"), path)
    return m.spark.read.schema(m.metrics().schema).option("header", True).csv(path)


@query("a11_normalize_types", "A11")
def _(m):
    raw = m.table("orders").select(
        F.col("o_orderkey").cast("string").alias("tran_id"),
        F.when(F.col("o_orderstatus") == "P", "2000-13-45").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("tran_date"),
        F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").otherwise("?").alias("valid"),
    )
    contract = StructType.fromDDL("tran_id BIGINT, tran_date DATE, valid BOOLEAN, not_there INT")
    return scans.normalize_types(raw, contract)


@query("a12_resolve_columns", "A12")
def _(m):
    upper = scans.upper_columns(m.sends())
    key = scans.resolve_column(upper, ["CAMPANHA", "NOMBRE_CAMPANHA"])
    return upper.groupBy(F.col(key).alias("campaign")).agg(F.countDistinct("RUT").alias("ruts"))


@query("a15_dataset_summary", "A15 D14")
def _(m):
    return scans.dataset_summary(m.attributed(), "cust_id", "rfm_segment")


@query("a16_month_scan", "A16")
def _(m):
    start = dt.date(2000, 3, 10)
    asked = scans.scan_month_column(m.redemptions(), start, whole_month=False).groupBy("mes").agg(F.count(F.lit(1)).alias("n"))
    whole = scans.scan_month_column(m.redemptions(), start).groupBy("mes").agg(F.count(F.lit(1)).alias("n_whole"))
    return whole.join(asked, "mes", "left")


# --- predicates and projections ----------------------------------------------------------------


@query("b2_defaults", "B1 B2")
def _(m):
    return m.features().select("cust_id", "t0", "recency_days", "monetary_total", "days_since_last_redeem", "avg_redeem_points")


@query("b6_text_matches", "B6 B7 D5")
def _(m):
    channel, price = F.col("bu_channel_name"), F.col("price_type_desc")
    return m.redemptions().groupBy("mes").agg(
        F.count_if(features.not_returned()).alias("not_returned"),
        F.count_if(F.col("return_flag").isNull()).alias("unknown"),
        F.count_if(F.coalesce(F.col("return_flag"), F.lit(False))).alias("returned"),
        F.count_if(text.mentions(channel, *features.DIGITAL_CHANNELS)).alias("digital"),
        F.count_if(text.mentions(price, "catalogo")).alias("catalogue"),
    )


@query("b8_drop_and_append", "B8 B9")
def _(m):
    base = lifecycle.lifecycle_base(m.snapshots(), START)
    again = ["loy_categoria", "flag_acumulador_dig_3p", "flag_acumulador_ikea"]
    kept = base.drop(*again, "loy_categoria_cierre").columns
    return base.select(*kept, F.upper("loy_categoria").alias("loy_categoria"), *again[1:])


@query("b10_purchase_filter", "B10")
def _(m):
    return features.purchases_in_window(m.trx(), T0)


@query("b11_redemption_filter", "B11")
def _(m):
    return features.redemptions_in_window(m.redemptions(), T0).select(
        "cust_id", "redemption_id_unico", "redemption_date", "redemption_points_amt"
    )


@query("b12_report_filters", "B4 B12")
def _(m):
    chosen = filters.Filters(start=dt.date(2000, 2, 1), end=dt.date(2000, 10, 31), client_types=["BANCO"])
    return filters.apply_filters(m.metrics(), chosen)


@query("b12_no_filters", "B12")
def _(m):
    return filters.apply_filters(m.metrics(), filters.Filters())


@query("b13_campaign_search", "B13")
def _(m):
    return filters.search_campaign(reports.send_history(m.metrics(), m.email()), r"NRO 1.?_")


@query("b14_drop_null_keys", "B14")
def _(m):
    known = filters.drop_null_keys(m.rfm(), ["tier", "gender"])
    return known.groupBy("tier", "gender").agg(F.count(F.lit(1)).alias("n"))


@query("b15_client_type", "B15")
def _(m):
    return features.client_type(m.clients()).select("cust_id", "tipo_cliente", "cust_stock_point_amt")


@query("b16_send_dates", "B16")
def _(m):
    return filters.distinct_values(m.metrics(), "FECHA_ENVIO", descending=True)


@query("b16_campaign_names", "B16")
def _(m):
    return filters.distinct_values(m.rfm_cube(), "NOMBRE_CAMPANHA")


@query("b17_campaign_slice", "B17")
def _(m):
    return filters.slice_campaign(m.metrics(), dt.date(2000, 7, 5), "Camp Nro 7_05072000")


# --- joins -------------------------------------------------------------------------------------


@query("c2_features_join", "C2")
def _(m):
    return m.outcomes().join(m.rfm().select("cust_id", "tier", "rfm_segment"), "cust_id")


@query("c3_scores_to_sends", "C3")
def _(m):
    attributed = attribution.attribute_redemptions(m.sends(), m.redemptions(), START, END)
    return metrics.score_attributed(attributed, m.rfm(), rfm.NO_SCORE).select(
        "NOMBRE_CAMPANHA", "GMGC", "cust_id", "FLAG_CANJE", "rfm_segment", "r_score"
    )


@query("c4_interval_join", "C4")
def _(m):
    windows = attribution.send_windows(m.sends(), START, END, "inicio_vigencia", "fin_vigencia")
    daily = attribution.redemption_daily(m.redemptions(), START, END)
    return intervals.interval_join(windows, daily, "cust_id", "inicio_vigencia", "fin_vigencia", "redemption_date").select(
        "nombre_campanha", "cust_id", "fin_vigencia", "redemption_date", "bu_channel_name", "canjes", "puntos_canjeados"
    )


@query("c6_month_end_asof", "C6 H12 G7")
def _(m):
    return lifecycle.lifecycle_base(m.snapshots(), START)


@query("c7_state_at", "C7")
def _(m):
    windows = m.sends().select("nombre_campanha", "rut", "inicio_vigencia", "fin_vigencia")
    asked = windows.select(F.col("rut").alias("cust_id")).distinct()
    states = lifecycle.states_on(m.snapshots(), metrics.send_days(windows), START, asked)
    return lifecycle.state_at(windows, states, {"inicio_vigencia": "state_pre", "fin_vigencia": "state_post"})


@query("c6_from_intervals", "C6")
def _(m):
    return validity.month_end_asof(m.state_intervals(), m.calendar(), START)


@query("c6_interval_sizes", "C6")
def _(m):
    return validity.form_sizes(m.snapshots(), m.state_intervals())


@query("c7_from_intervals", "C7")
def _(m):
    windows = m.sends().select("nombre_campanha", "rut", "inicio_vigencia", "fin_vigencia")
    lookups = {"state_pre": ("inicio_vigencia", "tipo_canjeador"), "state_post": ("fin_vigencia", "tipo_canjeador")}
    return validity.state_on(windows, m.redeemer_intervals(), m.calendar(), lookups, "rut")


@query("c7_last_state", "C7")
def _(m):
    asked = m.sends().select("nombre_campanha", "rut", (F.col("fecha_envio") + F.expr("INTERVAL 9 DAY")).cast("date").alias("on_day"))
    return validity.last_state(asked, m.redeemer_intervals(), "on_day", "tipo_canjeador", "last_state", "rut")


@query("c7_interval_sizes", "C7")
def _(m):
    daily = m.snapshots().where(F.col("partition_date") >= F.lit(START))
    return validity.form_sizes(daily, m.redeemer_intervals())


@query("c8_needed_states", "C8")
def _(m):
    states = lifecycle.states_on(m.snapshots(), metrics.send_days(m.sends()), START)
    return lifecycle.needed_states(states, m.sends(), "inicio_vigencia")


@query("c12_email_match", "C12 C12b D11")
def _(m):
    campaigns = reports.campaign_rollup(m.metrics()).select("campaign", "send_date")
    return reports.match_email(campaigns, m.email())


@query("c12_email_match_dedupe", "C12b")
def _(m):
    campaigns = reports.campaign_rollup(m.metrics()).select("campaign", "send_date")
    return reports.match_email(campaigns, m.email(), dedupe=True)


# --- aggregations ------------------------------------------------------------------------------


@query("d3_customers_by_campaign", "D3 H22")
def _(m):
    keys = ["FECHA_ENVIO", "NOMBRE_CAMPANHA", "GMGC", "FLAG_CANJE"]
    added = m.metrics().groupBy(*keys).agg(F.sum("CLIENTES").alias("CLIENTES_SUMADOS"))
    counted = distinct.customers_by(m.cube_customers(), keys)
    same = [added[k].eqNullSafe(counted[k]) for k in keys]
    return added.join(counted, same).select(*[added[k] for k in keys], "CLIENTES_SUMADOS", "CLIENTES")


@query("d3_customers_by_channel", "D3 H22")
def _(m):
    return distinct.customers_by(m.cube_customers(), ["CANAL_CANJE", "GMGC"])


@query("d8_flag_modes", "D8 C4")
def _(m):
    return attribution.attribute_redemptions(m.sends(), m.redemptions(), START, END, mode="both")


@query("d10_distinct_sends", "D10")
def _(m):
    return attribution.send_windows(m.sends(), START, END, "inicio_vigencia", "fin_vigencia")


@query("d17_dominant_segment", "D17")
def _(m):
    return reports.dominant_segment(m.rfm_cube())


@query("d19_summary_kpis", "D19")
def _(m):
    return reports.summary_kpis(reports.campaign_summary(m.metrics(), m.email(), m.rfm_cube()))


@query("d22_first_last_send", "D22")
def _(m):
    return m.metrics().groupBy(F.col("NOMBRE_CAMPANHA").alias("campaign")).agg(
        F.min("FECHA_ENVIO").alias("first_send"), F.max("FECHA_ENVIO").alias("last_send")
    )


# --- ranking -----------------------------------------------------------------------------------


@query("e1_global_rank", "E1")
def _(m):
    return ranking.distributed_rank(m.features().select("cust_id", "frequency_total"), "frequency_total", "cust_id")


@query("e2_quintiles", "E2")
def _(m):
    return ranking.quintiles(m.features().select("cust_id", "monetary_total"), {"m_score": ("monetary_total", True)}, "cust_id")


@query("e3_deciles", "E3")
def _(m):
    binned = ranking.quantile_bins(_evaluation_rows(m), "p", "cust_id", 10)
    return binned.select("nombre_campanha", "cust_id", "decile")


@query("e7_sorted_history", "E7")
def _(m):
    return reports.send_history(m.metrics(), m.email()).select("campaign", "send_date")


@query("e8_custom_order", "E8")
def _(m):
    shares = reports.segment_shares(m.rfm())
    position = text.position_in(F.col("rfm_segment"), rfm.RFM_ORDER)
    return shares.select("rfm_segment", "n", position.alias("position")).orderBy("position")


@query("e9_top_campaigns", "E9")
def _(m):
    """All campaigns with their place; the report shows the first ones. One row per campaign, so one window is small."""
    place = F.row_number().over(Window.orderBy(F.col("redeemers_gm").desc(), "campaign"))
    return reports.campaign_rollup(m.metrics()).select("campaign", "redeemers_gm", "pct_gm", place.alias("place"))


@query("e12_mean_bands", "E12 H50")
def _(m):
    return reports.summary_bands(reports.campaign_summary(m.metrics(), m.email(), m.rfm_cube()))


@query("e13_segment_shares", "E13")
def _(m):
    return reports.segment_shares(m.rfm())


# --- pivots ------------------------------------------------------------------------------------


@query("f1_rfm_breakdown", "F1 F5 H29")
def _(m):
    return reports.rfm_breakdown(m.rfm_cube(), reports.campaign_rollup(m.metrics()))


@query("f2_segment_pivot", "F2 F6 H40 C14")
def _(m):
    return pivots.segment_pivot(m.metrics(), VALUE_PER_POINT)


@query("f3_transition_matrix", "F3 F5 H42")
def _(m):
    return pivots.transition_matrix(m.metrics())


@query("f3_transition_active", "F3 H42")
def _(m):
    return pivots.transition_matrix(m.metrics(), active_only=True)


@query("f4_tier_segment", "F4 H44")
def _(m):
    return pivots.tier_segment(m.rfm())


# --- scalar functions --------------------------------------------------------------------------


@query("g1_calendar_functions", "G1 G2 G3 G4 G5 G6 G7 G8 G9 G10 G23")
def _(m):
    day = F.col("o_orderdate").cast("date")
    return m.table("orders").select("o_orderkey", day.alias("day")).select(
        "o_orderkey",
        F.datediff(F.lit(T0), "day").alias("days_to_t0"),
        dates.month_diff(F.lit(T0), F.col("day")).alias("months_to_t0"),
        F.date_add("day", 5).alias("plus_5"),
        F.add_months("day", -12).alias("minus_12m"),
        F.add_months("day", 1).alias("plus_1m"),
        F.trunc("day", "month").alias("month_start"),
        F.last_day("day").alias("month_end"),
        dates.prev_month_end(F.col("day")).alias("prev_close"),
        dates.is_month_end(F.col("day")).alias("is_close"),
        *[value.cast("int").alias(name) for name, value in dates.send_calendar(F.col("day")).items()],
        dates.year_month(F.col("day")).alias("ym"),
    )


@query("g11_name_functions", "G11 G12 G13")
def _(m):
    name = F.concat(F.lit(" "), F.lower("nombre_campanha"))
    return m.sends().select(
        "rut", "fin_vigencia", text.squash(name).alias("squashed"), text.norm_campaign(name).alias("camp_key"),
        text.base_key(text.norm_campaign(name)).alias("base_key"), F.upper("email_corporativo").alias("upper_email"),
    )


@query("g14_flags", "G14 I5")
def _(m):
    flags = ["contact_push_flg", "contact_email_flg", "cust_active_cmr_flg"]
    return model.encode_flags(m.clients(), flags).select("cust_id", *[F.col(f).cast("int").alias(f) for f in flags])


@query("g15_guarded_arithmetic", "G15 G16 D7")
def _(m):
    return m.rfm().select(
        "cust_id", F.greatest("spend_ch_a", "spend_ch_b", "spend_ch_c").alias("top3"),
        F.nullif(F.col("stock_points"), F.lit(0)).alias("stock_or_null"),
        F.try_divide("exp_points_next", "stock_points").alias("pressure_next"), "redeem_rate",
    )


@query("g17_rates_and_lift", "G17 G18 G20 G21 H37")
def _(m):
    return reports.group_rates(m.metrics())


@query("g22_labels", "G22")
def _(m):
    states = m.metrics().groupBy("GRUPO_CANJE_PRE").agg(F.sum("CLIENTES").alias("clients"))
    return states.select("GRUPO_CANJE_PRE", "clients", text.label_of(F.col("GRUPO_CANJE_PRE"), text.FUNNEL_LABELS).alias("label"))


@query("g24_bands", "G24 H50")
def _(m):
    cells = pivots.segment_cells(m.metrics())
    pct = F.col("redeem_pct")
    return cells.select("campaign", "cell", pct, ratios.band_pivot(pct).alias("band"), ratios.band_heat(pct).alias("heat"))


# --- features and segments ---------------------------------------------------------------------


@query("h1_customer_features", "H1 H2 H3 H4 C1 D1 D3 D4 D6 D7 G1 G2")
def _(m):
    return features.customer_features(m.clients(), m.trx(), m.redemptions(), T0, CHANNELS)


@query("h5_channel_entropy", "H5 G19")
def _(m):
    return m.features().select("cust_id", features.channel_entropy(SPEND).alias("retailer_entropy"))


@query("h6_rfm_scores", "H6 E2")
def _(m):
    narrow = m.features().select("cust_id", "recency_days", "frequency_total", "monetary_total")
    return rfm.rfm_scores(narrow)


@query("h7_rfm_segments", "H7 H8 G22")
def _(m):
    scored = rfm.rfm_scores(m.features().select("cust_id", "recency_days", "frequency_total", "monetary_total"))
    labelled = scored.withColumns({"rfm_segment": rfm.rfm_segment(), "rfm_strict": rfm.rfm_segment("strict")})
    return labelled.select("cust_id", "rfm_segment", "rfm_strict", rfm.priority(F.col("rfm_segment")).alias("prioridad"))


@query("h9_derived_features", "H9")
def _(m):
    base = m.features().select("cust_id", "frequency_total", "monetary_total", "redeem_count_pre", "stock_points")
    return features.derived_features(base)


@query("h43_segment_profile", "H43 D16 D21 E8 E13")
def _(m):
    return planning.segment_profile(m.rfm())


@query("h43_segment_kpis", "H43 D15")
def _(m):
    return planning.segment_kpis(m.rfm())


# --- lifecycle ---------------------------------------------------------------------------------


@query("h13_acumulador", "H13 H14 B3")
def _(m):
    out = lifecycle.acumulador(lifecycle.lifecycle_base(m.snapshots(), START), detailed=True)
    return out.select("partition_date", "cust_id", "tipo_acumulador", "tipo_acumulador_detallado")


@query("h15_canjeador", "H15 H16 B3 B7")
def _(m):
    out = lifecycle.canjeador(lifecycle.lifecycle_base(m.snapshots(), START), detailed=True)
    return out.select("partition_date", "cust_id", "tipo_canjeador", "tipo_canjeador_detallado")


def _counted(states: DataFrame, *by: str) -> DataFrame:
    return states.groupBy("partition_date", *by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cust_id").alias("customers"))


@query("h12_close_counts", "H12 C6")
def _(m):
    base = lifecycle.lifecycle_base(m.snapshots(), START)
    return base.groupBy("partition_date", "partition_cierre", "loy_categoria", "loy_categoria_cierre").agg(
        F.count(F.lit(1)).alias("n"), F.sum("flag_acumulador").alias("buyers"), F.sum("flag_acumulador_cierre").alias("buyers_at_close"),
        F.sum("flag_canjeador_12_24m_cierre").alias("redeemers_at_close"), F.max("ultima_compra_cierre").alias("last_buy_at_close"),
        F.max("ultimo_canje_cierre").alias("last_redeem_at_close"),
    )


@query("b8_upper_tier_counts", "B8 B9")
def _(m):
    base = lifecycle.lifecycle_base(m.snapshots(), START)
    return _counted(base.drop("loy_categoria_cierre").withColumn("tier", F.upper("loy_categoria")).drop("loy_categoria"), "tier")


@query("h13_acumulador_counts", "H13 H14 B3")
def _(m):
    states = lifecycle.acumulador(lifecycle.lifecycle_base(m.snapshots(), START), detailed=True)
    return _counted(states, "loy_categoria", "tipo_acumulador", "tipo_acumulador_detallado")


@query("h15_canjeador_counts", "H15 H16 B3 B7")
def _(m):
    states = lifecycle.canjeador(lifecycle.lifecycle_base(m.snapshots(), START), detailed=True)
    return _counted(states, "loy_categoria", "tipo_canjeador", "tipo_canjeador_detallado")


@query("h17_funnel_groups", "H17")
def _(m):
    states = lifecycle.canjeador(lifecycle.lifecycle_base(m.snapshots(), START))
    group = lifecycle.funnel_group(F.col("tipo_canjeador")).alias("grupo")
    return states.groupBy("partition_date", group).agg(F.count(F.lit(1)).alias("n"))


# --- identity and cube -------------------------------------------------------------------------


@query("h10_first_redemption", "H10")
def _(m):
    return attribution.first_redemption(m.redemptions())


@query("h11_redemption_daily", "H11 D2")
def _(m):
    return attribution.redemption_daily(m.redemptions(), START, END)


@query("h18_mail_campaigns", "H18 C9 C10")
def _(m):
    return identity.mail_campaigns(m.mail_sent(), m.mail_job(), START)


@query("h19_campaign_mail_match", "H19 C11 C13")
def _(m):
    return identity.campaign_mail_match(m.sends(), m.mail_sent(), m.mail_job(), START)


@query("h20_recipient_match", "H20 C11")
def _(m):
    return identity.recipient_match(m.sends(), m.mail_sent(), m.mail_job(), START)


@query("h21_measurement_identity", "H21")
def _(m):
    return identity.measurement_identity(m.sends(), m.mail_sent(), m.mail_job(), START, END)


@query("h22_campaign_metrics", "H22 H23 D2 D3 D13 C4 C7")
def _(m):
    return metrics.campaign_redemption_metrics(
        m.sends(), m.redemptions(), m.snapshots(), m.mail_sent(), m.mail_job(), START, END
    )


@query("h22_campaign_metrics_dedupe", "H22")
def _(m):
    return metrics.campaign_redemption_metrics(
        m.sends(), m.redemptions(), m.snapshots(), m.mail_sent(), m.mail_job(), START, END, dedupe=True
    )


@query("h24_attribution_window", "H24 C4 D8")
def _(m):
    return attribution.attribute_redemptions(m.sends(), m.redemptions(), START, END)


@query("h25_attribution_horizon", "H25 C5 D9")
def _(m):
    return attribution.attribute_redemptions_horizon(m.sends(), m.redemptions(), START, END)


@query("h26_rfm_campaigns", "H26 D12 B14")
def _(m):
    return metrics.rfm_campaigns(m.attributed())


# --- reports -----------------------------------------------------------------------------------


@query("h27_campaign_summary", "H27 D17 D18 C12")
def _(m):
    return reports.campaign_summary(m.metrics(), m.email(), m.rfm_cube())


@query("h28_engagement", "H28")
def _(m):
    return reports.engagement(m.email())


@query("h30_conversion_block", "H30 H31 G20")
def _(m):
    return reports.conversion_block(m.metrics())


@query("h32_uplift_by_state", "H32 C14")
def _(m):
    return reports.uplift_by_state(m.metrics())


@query("h33_uplift_by_segment", "H33 C15")
def _(m):
    return reports.uplift_by_segment(m.rfm_cube())


@query("h33_uplift_all_campaigns", "H33")
def _(m):
    return reports.uplift_all_campaigns(m.rfm_cube(), m.rfm())


@query("h33_uplift_selected", "H33 B12")
def _(m):
    return reports.uplift_all_campaigns(m.rfm_cube(), m.rfm(), ["Camp Nro 2_05022000", "Camp Nro 5_05052000"])


@query("h34_predicted_by_segment", "H34")
def _(m):
    return reports.predicted_by_segment(_predictions(m))


@query("h35_engagement_by_segment", "H35")
def _(m):
    return reports.engagement_by_segment(m.rfm_cube(), m.email(), _predictions(m))


@query("h36_who_redeemed", "H36")
def _(m):
    return reports.who_redeemed(m.metrics())


@query("h37_group_rates", "H37")
def _(m):
    return reports.group_rates(m.metrics())


@query("h38_send_base_profile", "H38")
def _(m):
    return reports.send_base_profile(m.sends())


@query("h39_redeemers_by_channel", "H39")
def _(m):
    return reports.redeemers_by_channel(m.metrics())


@query("h41_funnel_table", "H41")
def _(m):
    return pivots.funnel_table(m.metrics())


@query("h45_calibration_by_segment", "H45")
def _(m):
    return planning.calibration_by_segment(m.rfm(), m.rfm_cube())


@query("h45_calibration_kpis", "H45")
def _(m):
    return planning.calibration_kpis(planning.calibration_by_segment(m.rfm(), m.rfm_cube()))


_AUDIENCE = filters.Filters(segments=["Champions", "Loyal", "Nuevos"], tiers=["Elite", "PREMIUM"])


@query("h46_audience", "H46")
def _(m):
    return planning.audience_size(m.rfm(), _AUDIENCE)


def _scored_audience(m: Marts) -> DataFrame:
    chosen = planning.audience(m.rfm(), _AUDIENCE)
    return chosen.withColumn("p_5dias", evaluation.prior_correct(F.col("propensity_score"), F.lit(PRIOR_RATIO)))


@query("h47_audience_plan", "H47")
def _(m):
    points = planning.average_points(m.rfm(), ["monetary_monthly_avg"])
    return planning.audience_plan(_scored_audience(m), VALUE_PER_POINT, points)


@query("h47_plan_totals", "H47 D15")
def _(m):
    points = planning.average_points(m.rfm(), ["not_there", "avg_redeem_points"])
    return planning.plan_totals(_scored_audience(m), VALUE_PER_POINT, points)


@query("h48_send_history", "H48 D22 E7")
def _(m):
    return reports.send_history(m.metrics(), m.email())


@query("h49_monthly_trend", "H49 D20 G23")
def _(m):
    return reports.monthly_trend(reports.send_history(m.metrics(), m.email()))


# --- model -------------------------------------------------------------------------------------


def _evaluation_rows(m: Marts) -> DataFrame:
    """Customer sends with outcome, synthetic score and its prior-corrected form."""
    def build():
        joined = m.outcomes().join(m.rfm().select("cust_id", "rfm_segment", F.col("propensity_score").alias("p")), "cust_id")
        return joined.withColumn("cal", evaluation.prior_correct(F.col("p"), F.lit(PRIOR_RATIO)))

    return m._store("evaluation", build)


def _predictions(m: Marts) -> DataFrame:
    rows = _evaluation_rows(m).withColumnRenamed("nombre_campanha", "NOMBRE_CAMPANHA").withColumnRenamed("gmgc", "GMGC")
    return evaluation.rescale_to_rate(rows, "p", "canjeo_5d", PRIOR_RATIO, ["NOMBRE_CAMPANHA"])


_SEND_KEYS = ["fecha_envio", "nombre_campanha", "gmgc", "cust_id"]


@query("i1_downsample_counts", "I1")
def _(m):
    kept = model.downsample(m.outcomes(), "canjeo_5d", _SEND_KEYS)
    return kept.groupBy("canjeo_5d").agg(F.count(F.lit(1)).alias("n"))


@query("e10_union_of_samples", "E10 I1")
def _(m):
    """All positives and the drawn negatives as one table, counted by treatment."""
    sample = model.union_of_samples(m.outcomes(), "canjeo_5d", _SEND_KEYS)
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_if("canjeo_5d").alias("positives"), F.countDistinct(*_SEND_KEYS).alias("sends"))


@query("i2_campaign_context", "I2 G9 G10")
def _(m):
    rows = model.campaign_context(m.outcomes())
    return rows.select("nombre_campanha", "cust_id", *[F.col(c).cast("int").alias(c) for c in model.CONTEXT])


@query("i3_prepared_features", "I3 I5 A5")
def _(m):
    prepared = model.prepare(m.outcomes().join(m.rfm(), "cust_id"), SPEND)
    return prepared.select(
        "nombre_campanha", "cust_id", "tier", "gender", "city", "points_pressure", "contact_push_flg", "es_gm", "age"
    )


@query("i4_ordinal_codes", "I4")
def _(m):
    columns = ["tier", "dominant_retailer"]
    seen = model.fill_features(m.rfm(), [], columns)
    coded = encoding.with_codes(seen, encoding.code_table(seen, columns), columns)
    return coded.select("cust_id", *[F.col(f"{c}_code").cast("int").alias(f"{c}_code") for c in columns])


@query("i6_temporal_split", "I6 E6")
def _(m):
    train, test = model.temporal_split(m.outcomes(), "fecha_envio", "nombre_campanha")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("canjeo_5d").alias("positives"), F.max("fecha_envio").alias("last_send")
    )


@query("e6_temporal_cutoff", "E6")
def _(m):
    return model.temporal_cutoff(m.outcomes(), "fecha_envio", "nombre_campanha")


@query("i10_prior_correction", "I10")
def _(m):
    rows = _evaluation_rows(m)
    return rows.select("nombre_campanha", "cust_id", F.round("cal", 8).alias("cal"))


@query("i11_rescaled_scores", "I11 G21")
def _(m):
    return _predictions(m).select("NOMBRE_CAMPANHA", "cust_id", F.round("p_5dias", 8).alias("p_5dias"))


@query("i12_ranking_metrics", "I12 I13")
def _(m):
    out = evaluation.ranking_metrics(_evaluation_rows(m), "p", "canjeo_5d")
    return out.select(F.round("auc", 8).alias("auc"), F.round("average_precision", 8).alias("average_precision"))


@query("i14_brier", "I14")
def _(m):
    return evaluation.brier(_evaluation_rows(m), "cal", "canjeo_5d").select(F.round("brier", 8).alias("brier"))


@query("i15_decile_table", "I15 E4 E5")
def _(m):
    return evaluation.decile_table(_evaluation_rows(m), "p", "cal", "canjeo_5d", "cust_id")


@query("e5_top_decile_lift", "E5 I15")
def _(m):
    table = evaluation.decile_table(_evaluation_rows(m), "p", "cal", "canjeo_5d", "cust_id")
    return evaluation.top_decile_lift(table)


def _trained(m: Marts):
    """One training per session and data folder, with the production settings."""
    key = (m.spark.sparkContext.applicationId, m.sf_dir)
    if key not in _models:
        path = scratch_path(m.spark, "model")
        _models[key] = (*jobs.train_campaign_model(m.sends(), m.redemptions(), m.rfm(), START, END, SPEND, path), path)
    return _models[key]


_models: dict[tuple[str, str], tuple] = {}


@query("i7_train_model", "I7 I12 I13 I14 I15")
def _(m):
    return _trained(m)[1]


@query("i7_training_facts", "I7 I17")
def _(m):
    """What the trees do not change: sample, campaigns, cutoff and base rate."""
    return _trained(m)[1].select(
        (F.col("n_train") + F.col("n_test")).alias("n_rows"), "n_campaigns", "cutoff_date", F.round("base_rate_real", 8).alias("base_rate_real"),
    )


@query("i8_propensity_scores", "I8")
def _(m):
    """A model over the propensity inputs, fitted on whether the customer redeemed after any send, scores all customers."""
    redeemed = m.outcomes().groupBy("cust_id").agg(F.bool_or("canjeo_5d").alias("redeemed"))
    fitted = model.train_propensity(m.rfm().join(redeemed, "cust_id"), "redeemed")
    return model.propensity_scores(fitted, m.rfm())


@query("i8_scored_customers", "I8")
def _(m):
    """All customers have one score between 0 and 1."""
    scored = QUERIES["i8_propensity_scores"](m)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cust_id").alias("customers"), F.count_if(F.col("propensity_score").between(0, 1)).alias("in_range"))


@query("i9_isotonic", "I9")
def _(m):
    rows = _evaluation_rows(m)
    return model.calibrate(model.isotonic(rows, "p", "canjeo_5d"), rows, "p", 0.02).select("nombre_campanha", "cust_id", F.round("p", 8).alias("p"), F.round("cal", 8).alias("cal"))


@query("i16_importance", "I16 E9")
def _(m):
    return model.importance(_trained(m)[0], m.spark)


@query("i16_importance_facts", "I16")
def _(m):
    """One weight for each input, adding up to one."""
    table = model.importance(_trained(m)[0], m.spark)
    return table.agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sum("importance"), 6).alias("total"))


@query("i17_saved_model", "I17")
def _(m):
    """The stored bundle and the one in memory score all customers alike."""
    bundle, _, path = _trained(m)
    restored = model.load_bundle(path)
    rows = model.prepare(m.rfm().withColumns({"fecha_envio": F.lit(T0), "gmgc": F.lit("GM")}), SPEND)
    both = model.score(bundle, rows, "p", ["cust_id"]).join(model.score(restored, rows, "q", ["cust_id"]), "cust_id")
    same_facts = {k: v for k, v in restored.facts.items() if k not in ("metrics",)} == {k: v for k, v in bundle.facts.items() if k not in ("metrics",)}
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") != F.col("q")).alias("n_different")).withColumn("same_facts", F.lit(same_facts))


@query("i18_audience_plan", "I18 H47")
def _(m):
    chosen = planning.audience(m.rfm(), _AUDIENCE)
    predicted = model.predict_audience(_trained(m)[0], chosen, dt.date(2001, 1, 15))
    return planning.audience_plan(predicted, VALUE_PER_POINT, planning.average_points(m.rfm(), ["avg_redeem_points"]))


def _campaign_predictions(m: Marts) -> DataFrame:
    sends = m.attributed().select(
        "cust_id", F.col("FECHA_ENVIO").alias("fecha_envio"), F.col("NOMBRE_CAMPANHA").alias("nombre_campanha"),
        F.col("GMGC").alias("gmgc"), (F.col("FLAG_CANJE") == "CANJEO").alias("canjeo"),
    )
    return model.predict_campaigns(_trained(m)[0], sends, m.rfm().drop("fecha_envio"), keep=["nombre_campanha", "cust_id", "gmgc", "rfm_segment", "canjeo"])


@query("i18_campaign_predictions", "I18 I11")
def _(m):
    return _campaign_predictions(m).select("nombre_campanha", "cust_id", "gmgc", "rfm_segment", "p", "p_5dias")


@query("i18_campaign_rates", "I18 I11")
def _(m):
    """Per campaign: rows, observed rate, and whether the mean of the scaled scores is that rate (clipping can only
    lower it; campaigns without one are corrected by the prior)."""
    rate, mean = F.avg(F.col("canjeo").cast("int")), F.avg("p_5dias")
    near = F.when(rate <= evaluation.MIN_OBSERVED_RATE, True).when(F.max("p_5dias") < 1, F.abs(mean - rate) < 1e-6).otherwise(mean <= rate + 1e-9)
    return _campaign_predictions(m).groupBy("nombre_campanha").agg(
        F.count(F.lit(1)).alias("n"), F.round(rate, 8).alias("rate"), near.alias("keeps_rate"), F.count_if(F.col("p_5dias").between(0, 1)).alias("in_range")
    )
