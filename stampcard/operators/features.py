"""Customer features over a 12-month look-back: recency, frequency, money, channels, redemptions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from stampcard.functions.dates import month_diff, months_before
from stampcard.functions.text import mentions

# Defaults of the feature set.
NEVER_DAYS = 999
NO_DATE = dt.date(2000, 1, 1)
NO_CHANNEL = "NINGUNO"
LONG_HORIZON_TIERS = ["ELITE", "PREMIUM"]
PAYMENT_SHARES = {"pct_cmr_payments": "CMR", "pct_debit_payments": "DEB"}
DIGITAL_CHANNELS = ["digital", "online", "app"]
PRICE_SHARES = {"pct_redeem_catalogo": "catalogo", "pct_redeem_giftcard": "giftcard"}
PASSED_FLAGS = [
    "cust_active_cmr_flg", "cust_active_deb_flg", "contact_email_flg", "contact_phone_flg", "contact_push_flg",
    "cust_active_omp_flg",
]


def spend_column(channel: str) -> str:
    return f"spend_{channel.lower()}"


def purchases_in_window(trx: DataFrame, t0: dt.date, months: int = 12) -> DataFrame:
    """Valid purchases with a positive amount in [t0 - months, t0)."""
    return trx.where(
        (F.col("tran_date") >= months_before(t0, months))
        & (F.col("tran_date") < F.lit(t0))
        & (F.col("tran_type") == "COMPRA")
        & (F.col("tran_amt") > 0)
        & (F.col("tran_valid_flg") == 1)
    )


def redemptions_in_window(rdm: DataFrame, t0: dt.date, months: int = 12) -> DataFrame:
    """Redemptions known not to be returned in [t0 - months, t0); an unknown return flag does not count."""
    return rdm.where(
        (F.col("redemption_date") >= months_before(t0, months))
        & (F.col("redemption_date") < F.lit(t0))
        & not_returned()
    )


def not_returned() -> Column:
    """``return_flag IS FALSE``: null is not false. Written as an equality so that it reaches the scan."""
    return F.col("return_flag") == F.lit(False)


def purchase_features(trx: DataFrame, t0: dt.date, channels: list[str], months: int = 12,
                      fast_days: tuple[int, ...] = (30, 90)) -> DataFrame:
    """One row per buying customer.

    Distinct transactions are counted by first folding the lines of a transaction into one row and then
    counting rows, instead of expanding the input once per distinct count. The first fold also spreads a
    customer who holds a large share of the lines over many tasks.
    """
    channel = F.upper("channel_name")
    sums = {spend_column(name): F.when(channel == name, F.col("tran_amt")).otherwise(0) for name in channels}
    counts = {name: mentions(F.col("payment_method_name"), text) for name, text in PAYMENT_SHARES.items()}
    per_transaction = (
        purchases_in_window(trx, t0, months)
        .groupBy("cust_id", "tran_id")
        .agg(
            F.max("tran_date").alias("last_date"),
            F.sum("tran_amt").alias("amount"),
            *[F.sum(value).alias(name) for name, value in sums.items()],
            *[F.count_if(found).alias(name) for name, found in counts.items()],
        )
    )
    known = F.col("tran_id").isNotNull()
    orders = F.count_if(known)
    return per_transaction.groupBy("cust_id").agg(
        F.max("last_date").alias("last_tran_date"),
        orders.alias("frequency_total"),
        F.sum("amount").alias("monetary_total"),
        *[
            F.count_if(known & (F.col("last_date") >= F.lit(t0 - dt.timedelta(days=days)))).alias(f"earn_velocity_{days}")
            for days in fast_days
        ],
        *[F.sum(name).alias(name) for name in sums],
        *[F.try_divide(F.sum(name), orders).alias(name) for name in counts],
    )


def redemption_features(rdm: DataFrame, t0: dt.date, months: int = 12) -> DataFrame:
    """One row per redeeming customer. A repeated redemption id counts once, its lines count in the shares."""
    shares = {"pct_redeem_digital": mentions(F.col("bu_channel_name"), *DIGITAL_CHANNELS)}
    shares |= {name: mentions(F.col("price_type_desc"), text) for name, text in PRICE_SHARES.items()}
    per_id = (
        redemptions_in_window(rdm, t0, months)
        .groupBy("cust_id", "redemption_id_unico")
        .agg(
            F.max("redemption_date").alias("last_date"),
            F.count(F.lit(1)).alias("lines"),
            F.count("redemption_points_amt").alias("point_lines"),
            F.sum("redemption_points_amt").alias("points"),
            *[F.count_if(found).alias(name) for name, found in shares.items()],
        )
    )
    lines = F.sum("lines")
    return per_id.groupBy("cust_id").agg(
        F.count("redemption_id_unico").alias("redeem_count_pre"),
        F.max("last_date").alias("last_redeem_date"),
        F.try_divide(F.sum("points"), F.sum("point_lines")).alias("avg_redeem_points"),
        *[F.try_divide(F.sum(name), lines).alias(name) for name in shares],
    )


def client_snapshot(clients: DataFrame, t0: dt.date) -> DataFrame:
    """Client attributes as of ``t0``; reads a single snapshot where the entity is stored by date."""
    columns = {name.lower() for name in clients.columns}
    if "partition_date" in columns:
        clients = clients.where(F.col("partition_date") == F.lit(t0))
    return clients.select(
        "cust_id",
        F.upper("cat_cust_name").alias("tier"),
        F.col("cust_gender_desc").alias("gender"),
        F.col("cust_age_num").alias("age"),
        F.col("city_name").alias("city"),
        *[name for name in PASSED_FLAGS if name in columns],
        F.col("cust_stock_point_amt").alias("stock_points"),
        F.col("exp_point_current_month_amt").alias("exp_points_current"),
        F.col("exp_point_next_month_amt").alias("exp_points_next"),
        F.col("cust_enroll_date").alias("enrollment_date"),
        F.lit(t0).alias("t0"),
    )


def client_type(clients: DataFrame) -> DataFrame:
    """BANCO with one or both card products, else OMP with the open-loop product, else null.

    Only known flag pairs count as a card customer: a missing partner flag matches nothing.
    """
    first, second = F.col("cust_active_cmr_flg"), F.col("cust_active_deb_flg")
    known = first.isin("Y", "N") & second.isin("Y", "N")
    holds_card = known & ((first == "Y") | (second == "Y"))
    kind = F.when(holds_card, "BANCO").when(F.col("cust_active_omp_flg") == "Y", "OMP")
    return clients.withColumn("tipo_cliente", kind)


def dominant_channel(channels: list[str]) -> Column:
    """Channel with the highest spend; ties go to the earlier one in the list, no spend to a label."""
    spends = [F.col(spend_column(name)) for name in channels]
    top = F.greatest(*spends)
    out = F.when(top == 0, F.lit(NO_CHANNEL))
    for name, spend in zip(channels, spends):
        out = out.when(spend == top, F.lit(name))
    return out


def funnel_state() -> Column:
    """Simple lifecycle state from the window's redemptions and purchases."""
    horizon = F.when(F.col("tier").isin(LONG_HORIZON_TIERS), 730).otherwise(365)
    idle = F.datediff(F.col("t0"), F.coalesce(F.col("last_redeem_date"), F.lit(NO_DATE)))
    redeems, buys = F.col("redeem_count_pre"), F.col("frequency_total") >= 1
    return (
        F.when((redeems >= 1) & (idle > horizon), "FUGADO")
        .when(redeems >= 2, "RECURRENTE")
        .when(redeems == 1, "CANJEADOR")
        .when(buys & (F.col("stock_points") >= 1000), "POSIBILIDAD_CANJE")
        .when(buys, "PARTICIPANTE")
        .otherwise("INSCRITO")
    )


def days_since(day: str) -> Column:
    return F.coalesce(F.datediff("t0", day), F.lit(NEVER_DAYS)).cast("bigint")


def days_since_last_activity() -> Column:
    """Days to the later of last purchase and last redemption. A customer with neither counts from a fixed
    early date, so the result is thousands of days."""
    seen = F.greatest(*[F.coalesce(F.col(c), F.lit(NO_DATE)) for c in ("last_tran_date", "last_redeem_date")])
    return F.datediff("t0", seen).cast("bigint")


def customer_features(clients: DataFrame, trx: DataFrame, rdm: DataFrame, t0: dt.date, channels: list[str],
                      months: int = 12, fast_days: tuple[int, ...] = (30, 90)) -> DataFrame:
    """Every client of the snapshot with purchase and redemption features, zeros where inactive."""
    buys = purchase_features(trx, t0, channels, months, fast_days)
    redeems = redemption_features(rdm, t0, months)
    base = client_snapshot(clients, t0)
    joined = base.join(buys, "cust_id", "left").join(redeems, "cust_id", "left")
    dates = {"last_tran_date", "last_redeem_date"}
    measures = [c for c in [*buys.columns, *redeems.columns] if c not in dates | {"cust_id"}]
    filled = joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in measures})
    return filled.withColumns(
        {
            "recency_days": days_since("last_tran_date"),
            "days_since_last_redeem": days_since("last_redeem_date"),
            "days_since_last_activity": days_since_last_activity(),
            "points_pressure": F.try_divide("exp_points_current", "stock_points"),
            "tenure_months": month_diff(F.col("t0"), F.col("enrollment_date")),
            "dominant_retailer": dominant_channel(channels),
            "funnel_state_at_t0": funnel_state(),
        }
    ).drop(*dates)


def channel_entropy(spend_columns: list[str]) -> Column:
    """Shannon entropy of the spend shares, rounded to 4 places; 0 without spend."""
    total = sum((F.col(name) for name in spend_columns[1:]), F.col(spend_columns[0]))
    whole = F.when(total == 0, F.lit(1)).otherwise(total)
    entropy = F.lit(0.0)
    for name in spend_columns:
        share = F.greatest(F.try_divide(F.col(name).cast("double"), whole), F.lit(0.0))
        entropy = entropy - F.when(share > 0, share * F.ln(share + F.lit(1e-9))).otherwise(F.lit(0.0))
    return F.round(entropy, 4)


def derived_features(df: DataFrame) -> DataFrame:
    """Monthly averages, redeem rate and the stock alias; columns already present are kept."""
    orders = F.when(F.col("frequency_total") == 0, F.lit(1)).otherwise(F.col("frequency_total"))
    wanted = {
        "frequency_monthly_avg": F.col("frequency_total") / F.lit(12.0),
        "monetary_monthly_avg": F.col("monetary_total") / F.lit(12.0),
        "redeem_rate": F.try_divide(F.col("redeem_count_pre"), orders),
        "stock_points_at_t0": F.col("stock_points"),
    }
    return df.withColumns({name: value for name, value in wanted.items() if name not in df.columns})
