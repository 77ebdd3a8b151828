"""Report datasets over the metrics cube, the segment cube and the e-mail feed.

Cubes are small next to the entities they come from; every report is one or two conditional aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stampcard.functions import ratios
from stampcard.functions.dates import year_month
from stampcard.functions.ratios import floored_lift, rate, spct
from stampcard.functions.text import FUNNEL_LABELS, FUNNEL_ORDER, base_key, is_redeemed, label_of, norm_campaign, position_in
from stampcard.operators.metrics import exact_sum, narrowed
from stampcard.operators.rfm import NO_SCORE, RFM_ORDER
from stampcard.session import materialize


def _treated() -> Column:
    return F.col("GMGC") == "GM"


def _control() -> Column:
    return F.col("GMGC") == "GC"


def _exact_flag() -> Column:
    return F.col("FLAG_CANJE") == "CANJEO"


def clients_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("CLIENTES"))), F.lit(0)).cast("bigint")


def uplift_columns(redeemed: Column, lift_decimals: int = 2) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates of treated and control clients, and the rates and lift derived from them."""
    sums = [
        clients_where(_treated()).alias("total_gm"),
        clients_where(_treated() & redeemed).alias("redeemers_gm"),
        clients_where(_control()).alias("total_gc"),
        clients_where(_control() & redeemed).alias("redeemers_gc"),
    ]
    pct_gm = spct(F.col("redeemers_gm"), F.col("total_gm"))
    pct_gc = spct(F.col("redeemers_gc"), F.col("total_gc"))
    derived = {"pct_gm": pct_gm, "pct_gc": pct_gc, "lift_pp": floored_lift(pct_gm, pct_gc, lift_decimals)}
    return sums, derived


# --- e-mail engagement -------------------------------------------------------------------------


def engagement(email: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums and rates per campaign. Rates are null for a campaign without mails."""
    keys = keys or ["campaign_name"]
    sums = [
        F.sum(name).cast("bigint").alias(name)
        for name in ["casos", "total_mails", "total_opens", "total_clicks", "total_bounces", "total_unsubs"]
    ]
    totals = email.dropna(subset=keys).groupBy(*keys).agg(*sums)
    mails = F.col("total_mails")
    return totals.withColumns(
        {
            "open_pct": rate(F.col("total_opens"), mails),
            "click_pct": rate(F.col("total_clicks"), mails),
            "bounce_pct": rate(F.col("total_bounces"), mails),
        }
    )


def engagement_by_key(email: DataFrame) -> DataFrame:
    """Engagement per normalised campaign name."""
    return engagement(email.withColumn("camp_key", norm_campaign(F.col("campaign_name"))), ["camp_key"])


def match_email(campaigns: DataFrame, email: DataFrame, dedupe: bool = False) -> DataFrame:
    """Attach engagement to campaigns by normalised name, then by name without its date.

    Several feed spellings of one key repeat the campaign row; ``dedupe=True`` adds them up first. The second
    pass serves only campaigns without an exact match and takes the first feed name in order.
    """
    if dedupe:
        feed = engagement_by_key(email).withColumn("campaign_name", F.col("camp_key"))
    else:
        feed = engagement(email).withColumn("camp_key", norm_campaign(F.col("campaign_name")))
    values = ["sent", "open_pct", "click_pct", "bounce_pct"]
    feed = feed.withColumnRenamed("total_mails", "sent").withColumn("base_key", base_key(F.col("camp_key")))
    first = F.min_by(F.struct(*values), "campaign_name").alias("fallback")
    by_base = feed.groupBy("base_key").agg(first)

    keyed = campaigns.withColumn("camp_key", norm_campaign(F.col("campaign")))
    keyed = keyed.withColumn("base_key", base_key(F.col("camp_key")))
    exact = keyed.join(feed.select("camp_key", *values), "camp_key", "left")
    unmatched = F.col("sent").isNull()
    both = exact.join(by_base, "base_key", "left")
    filled = {name: F.when(unmatched, F.col(f"fallback.{name}")).otherwise(F.col(name)) for name in values}
    return both.select(*campaigns.columns, *[value.alias(name) for name, value in filled.items()])


# --- campaign overview -------------------------------------------------------------------------


def dominant_segment(rfm_cube: DataFrame) -> DataFrame:
    """Segment with most treated customers per campaign, and its redemption rate."""
    sizes = rfm_cube.where(_treated()).groupBy("NOMBRE_CAMPANHA", "rfm_segment").agg(
        F.sum("CLIENTES").alias("total"), clients_where(_exact_flag()).alias("redeemed")
    )
    order = Window.partitionBy("NOMBRE_CAMPANHA").orderBy(F.col("total").desc(), F.col("rfm_segment"))
    top = sizes.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1)
    return top.select(
        F.col("NOMBRE_CAMPANHA").alias("campaign"),
        F.col("rfm_segment").alias("top_segment"),
        spct(F.col("redeemed"), F.col("total")).alias("top_segment_pct"),
    )


def campaign_rollup(metrics: DataFrame) -> DataFrame:
    """One row per campaign: last send date, rates of both groups, lift and new redeemers."""
    redeemed = is_redeemed(F.col("FLAG_CANJE"))
    sums, derived = uplift_columns(redeemed)
    fresh = _treated() & (F.col("GRUPO_CANJE_PRE") == "NO_CANJEADOR_HISTORICO") & _exact_flag()
    rolled = metrics.dropna(subset=["NOMBRE_CAMPANHA"]).groupBy(F.col("NOMBRE_CAMPANHA").alias("campaign")).agg(
        F.max("FECHA_ENVIO").alias("send_date"), *sums, clients_where(fresh).alias("new_redeemers")
    )
    conv = spct(F.col("new_redeemers"), F.col("total_gm"))
    return rolled.withColumns({**derived, "conv_pct": conv})


def campaign_summary(metrics: DataFrame, email: DataFrame, rfm_cube: DataFrame, dedupe: bool = False) -> DataFrame:
    """Overview table, newest campaign first."""
    rolled = campaign_rollup(metrics).join(dominant_segment(rfm_cube), "campaign", "left")
    rows = rolled.select(
        "campaign", "send_date", "redeemers_gm", "pct_gm", "pct_gc", "lift_pp", "new_redeemers", "conv_pct",
        F.coalesce("top_segment", F.lit("—")).alias("top_segment"),
        F.coalesce("top_segment_pct", F.lit(0.0)).alias("top_segment_pct"),
    )
    return match_email(rows, email, dedupe).orderBy(F.col("send_date").desc_nulls_last(), "campaign")


def summary_kpis(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("campaigns"),
        F.sum("sent").alias("mails_sent"),
        F.sum("redeemers_gm").alias("redeemers_gm"),
        F.sum("new_redeemers").alias("new_redeemers"),
        F.round(F.avg("pct_gm"), 6).alias("mean_pct_gm"),
        F.round(F.avg("lift_pp"), 6).alias("mean_lift_pp"),
    )


def summary_bands(summary: DataFrame) -> DataFrame:
    """Traffic lights against the column means, which come from one scalar subquery."""
    judged = ["pct_gm", "conv_pct", "top_segment_pct"]
    means = summary.agg(F.struct(*[F.avg(c).alias(c) for c in judged])).scalar()
    bands = {f"{c}_band": ratios.band_mean(F.col(c), means[c]) for c in judged}
    bands["lift_band"] = ratios.band_lift(F.col("lift_pp"))
    return summary.select("campaign", *[band.alias(name) for name, band in bands.items()])


def rfm_breakdown(rfm_cube: DataFrame, campaigns: DataFrame | None = None) -> DataFrame:
    """Redemption rate of treated customers per campaign and segment; null where the segment is empty."""
    treated = rfm_cube.where(_treated())
    pct = F.when(F.sum("CLIENTES") > 0, spct(clients_where(_exact_flag()), F.sum("CLIENTES")))
    wide = treated.groupBy(F.col("NOMBRE_CAMPANHA").alias("campaign")).pivot("rfm_segment", RFM_ORDER).agg(pct)
    named = wide.select("campaign", *[F.col(f"`{seg}`").alias(segment_column(seg)) for seg in RFM_ORDER])
    return named if campaigns is None else campaigns.select("campaign").join(named, "campaign", "left")


def segment_column(segment: str) -> str:
    return segment.lower().replace(" ", "_")


# --- one campaign ------------------------------------------------------------------------------


def conversion_block(metrics: DataFrame) -> DataFrame:
    """Per campaign: redeemers by prior state, treated/control rates and incremental redeemers and points.

    Incremental redeemers are computed from the rounded rates, floored at zero and cut to whole numbers.
    """
    sums, derived = uplift_columns(_exact_flag())
    pre = F.col("GRUPO_CANJE_PRE")
    points = F.coalesce(exact_sum(F.when(_treated() & _exact_flag(), F.col("PUNTOS_CANJEADOS"))), F.lit(0))
    rolled = metrics.groupBy(F.col("NOMBRE_CAMPANHA").alias("campaign")).agg(
        *sums,
        clients_where(_treated() & _exact_flag() & (pre == "NO_CANJEADOR_HISTORICO")).alias("new_redeemers"),
        clients_where(_treated() & _exact_flag() & (pre == "FUGADOS")).alias("recovered"),
        clients_where(_treated() & _exact_flag() & (pre == "RECURRENTE")).alias("recurrent"),
        points.alias("points_gm"),
    )
    out = rolled.withColumns(derived).withColumn("activated", F.col("new_redeemers") + F.col("recovered"))
    out = out.withColumn("activated_pct", spct(F.col("activated"), F.col("total_gm")))
    return narrowed(materialize(incremental(out), "conversion"), "points_gm", "incremental_points")


def incremental(block: DataFrame) -> DataFrame:
    gain = (F.col("pct_gm") / 100 - F.col("pct_gc") / 100) * F.col("total_gm")
    extra = F.greatest(F.lit(0).cast("bigint"), gain.cast("bigint"))
    per_redeemer = F.col("points_gm").cast("double") / F.greatest(F.col("redeemers_gm"), F.lit(1))
    out = block.withColumn("incremental", extra)
    won = F.col("incremental") * per_redeemer
    whole = F.when(won < 2.0**63, won.cast("bigint")).otherwise((won - won % 1).cast("decimal(38,0)"))
    return out.withColumns(
        {
            "incremental_pct": spct(F.col("incremental"), F.col("total_gm")),
            "incremental_points": whole,
        }
    )


def uplift_by(cube: DataFrame, dim: str, order: list[str], dense: bool = False, lift_decimals: int = 2,
              by_campaign: bool = True) -> DataFrame:
    """Treated and control clients, redeemers, rates and lift by one dimension.

    ``dense`` gives every value of ``order`` for each campaign, with zeros; otherwise values without clients are
    left out. Values outside ``order`` are not reported.
    """
    sums, derived = uplift_columns(_exact_flag(), lift_decimals)
    keys = [F.col("NOMBRE_CAMPANHA").alias("campaign")] if by_campaign else []
    names = ["campaign", dim] if by_campaign else [dim]
    totals = cube.where(F.col(dim).isin(order)).groupBy(*keys, dim).agg(*sums)
    if dense:
        campaigns = cube.select(*keys).distinct()
        values = F.explode(F.array(*[F.lit(v) for v in order])).alias(dim)
        measures = ["total_gm", "redeemers_gm", "total_gc", "redeemers_gc"]
        totals = campaigns.select("*", values).join(totals, names, "left").fillna(0, measures)
    else:
        totals = totals.where((F.col("total_gm") > 0) | (F.col("total_gc") > 0))
    return totals.withColumns(derived)


def uplift_by_state(metrics: DataFrame) -> DataFrame:
    """GM against GC by prior state, every state reported."""
    return uplift_by(metrics, "GRUPO_CANJE_PRE", FUNNEL_ORDER, dense=True).withColumn(
        "label", label_of(F.col("GRUPO_CANJE_PRE"), FUNNEL_LABELS)
    )


def uplift_by_segment(rfm_cube: DataFrame) -> DataFrame:
    """GM against GC by segment, within each campaign."""
    return uplift_by(rfm_cube, "rfm_segment", [*RFM_ORDER, NO_SCORE], lift_decimals=1)


def uplift_all_campaigns(rfm_cube: DataFrame, rfm: DataFrame, campaigns: list[str] | None = None) -> DataFrame:
    """GM against GC by segment over the chosen campaigns (none chosen: all), with the share of the base."""
    chosen = rfm_cube.where(F.col("NOMBRE_CAMPANHA").isin(campaigns)) if campaigns else rfm_cube
    table = uplift_by(chosen, "rfm_segment", RFM_ORDER, lift_decimals=1, by_campaign=False)
    shares = segment_shares(rfm)
    return table.join(shares.select("rfm_segment", "pct_base"), "rfm_segment", "left").orderBy(
        F.col("pct_gm").desc(), position_in(F.col("rfm_segment"), RFM_ORDER)
    )


def segment_shares(rfm: DataFrame) -> DataFrame:
    sizes = rfm.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("rfm_segment", "n", spct(F.col("n"), sizes.agg(F.sum("n")).scalar()).alias("pct_base"))


def predicted_by_segment(predictions: DataFrame) -> DataFrame:
    """Mean predicted probability of treated customers by campaign and segment, in percent."""
    return predictions.where(_treated() & F.col("rfm_segment").isNotNull()).groupBy(
        F.col("NOMBRE_CAMPANHA").alias("campaign"), "rfm_segment"
    ).agg(F.round(F.avg("p_5dias") * 100, 1).alias("pred_pct"))


def engagement_by_segment(rfm_cube: DataFrame, email: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Campaign open and click rates repeated on each segment's uplift row."""
    rows = uplift_by_segment(rfm_cube).withColumn("camp_key", norm_campaign(F.col("campaign")))
    joined = rows.join(engagement_by_key(email).select("camp_key", "open_pct", "click_pct"), "camp_key", "left")
    out = joined.select("campaign", "rfm_segment", "open_pct", "click_pct", "pct_gm", "pct_gc", "lift_pp")
    return out if predictions is None else out.join(predicted_by_segment(predictions), ["campaign", "rfm_segment"], "left")


def who_redeemed(metrics: DataFrame) -> DataFrame:
    """Clients and redeemers per prior state, both groups together."""
    pre = F.col("GRUPO_CANJE_PRE")
    totals = metrics.where(pre.isin(FUNNEL_ORDER)).groupBy(F.col("NOMBRE_CAMPANHA").alias("campaign"), pre).agg(
        F.sum("CLIENTES").alias("total"), clients_where(is_redeemed(F.col("FLAG_CANJE"))).alias("redeemers")
    )
    return totals.select(
        "campaign", "GRUPO_CANJE_PRE", label_of(pre, FUNNEL_LABELS).alias("label"), "total", "redeemers",
        spct(F.col("redeemers"), F.col("total")).alias("pct"),
    )


def group_rates(metrics: DataFrame) -> DataFrame:
    """Redemption rate of both groups and the lift, per campaign."""
    sums, derived = uplift_columns(is_redeemed(F.col("FLAG_CANJE")))
    return metrics.groupBy(F.col("NOMBRE_CAMPANHA").alias("campaign")).agg(*sums).withColumns(derived).select(
        "campaign", "pct_gm", "pct_gc", "lift_pp"
    )


def send_base_profile(sends: DataFrame) -> DataFrame:
    keys = ["tipo_cliente", "gmgc", "canal", "tipo_medicion"]
    return sends.dropna(subset=["nombre_campanha", *keys]).groupBy(
        F.col("nombre_campanha").alias("campaign"), *keys
    ).agg(F.count(F.lit(1)).alias("ruts"))


def redeemers_by_channel(metrics: DataFrame) -> DataFrame:
    redeemed = metrics.where(F.upper("FLAG_CANJE") == "CANJEO").dropna(subset=["CANAL_CANJE"])
    return redeemed.groupBy(F.col("NOMBRE_CAMPANHA").alias("campaign"), F.col("CANAL_CANJE").alias("channel")).agg(
        F.sum("CLIENTES").alias("redeemers")
    )


# --- history and trend -------------------------------------------------------------------------


def send_history(metrics: DataFrame, email: DataFrame) -> DataFrame:
    """Per campaign: first send date, treated totals, rates, lift and exactly matched engagement."""
    sums, derived = uplift_columns(_exact_flag(), lift_decimals=1)
    rolled = metrics.dropna(subset=["NOMBRE_CAMPANHA"]).groupBy(F.col("NOMBRE_CAMPANHA").alias("campaign")).agg(
        F.min("FECHA_ENVIO").alias("send_date"), *sums
    )
    rows = rolled.withColumns({**derived, "camp_key": norm_campaign(F.col("campaign"))})
    joined = rows.join(engagement_by_key(email).select("camp_key", "open_pct", "click_pct"), "camp_key", "left")
    return joined.select(
        "campaign", "send_date", "total_gm", "redeemers_gm", "pct_gm", "pct_gc", "lift_pp", "open_pct", "click_pct"
    ).orderBy(F.col("send_date").desc_nulls_last(), "campaign")


def monthly_trend(history: DataFrame) -> DataFrame:
    """Campaigns and mean treated rate per send month; campaigns without a date are left out."""
    return history.where(F.col("send_date").isNotNull()).groupBy(year_month(F.col("send_date")).alias("month")).agg(
        F.count("campaign").alias("campaigns"), F.round(F.avg("pct_gm"), 6).alias("mean_pct_gm")
    ).orderBy("month")
