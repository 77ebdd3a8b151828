"""Loyalty entities derived from the benchmark tables (see FIXTURES.md).

Every entity is a lazy frame over the given tables, so filters and column pruning reach their scans.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

T0 = dt.date(2000, 12, 31)
START, END = dt.date(2000, 1, 1), dt.date(2000, 12, 31)
CHANNELS = ["CH_A", "CH_B", "CH_C", "CH_D", "CH_E"]
SPEND = [f"spend_{name.lower()}" for name in CHANNELS]

_CLIENTS = """
SELECT c_custkey AS cust_id,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CASE c_custkey % 4 WHEN 0 THEN 'Elite' WHEN 1 THEN 'Premium' WHEN 2 THEN 'Normal' ELSE 'Fan' END END AS cat_cust_name,
  CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE NULL END AS cust_gender_desc,
  CAST(18 + c_custkey % 60 AS INT) AS cust_age_num,
  n_name AS city_name,
  CASE c_custkey % 5 WHEN 0 THEN 'Y' WHEN 4 THEN NULL ELSE 'N' END AS cust_active_cmr_flg,
  CASE WHEN c_custkey % 7 < 3 THEN 'Y' ELSE 'N' END AS cust_active_deb_flg,
  CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS cust_active_omp_flg,
  CASE WHEN c_custkey % 3 = 1 THEN 'Y' ELSE 'N' END AS contact_email_flg,
  CASE WHEN c_custkey % 4 = 1 THEN 'Y' ELSE 'N' END AS contact_phone_flg,
  CASE c_custkey % 6 WHEN 0 THEN 'si' WHEN 1 THEN NULL ELSE '0' END AS contact_push_flg,
  CASE WHEN c_acctbal < 0 THEN 0 ELSE CAST(floor(c_acctbal) AS BIGINT) END AS cust_stock_point_amt,
  CAST(c_custkey % 400 AS BIGINT) AS exp_point_current_month_amt,
  CAST(c_custkey % 250 AS BIGINT) AS exp_point_next_month_amt,
  DATE '1995-01-01' + CAST((c_custkey * 7) % 2200 AS INT) AS cust_enroll_date
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

_TRX = """
SELECT o_orderkey AS tran_id, o_custkey AS cust_id, CAST(o_orderdate AS DATE) AS tran_date,
  CAST(floor(l_extendedprice) AS BIGINT) AS tran_amt,
  CASE WHEN l_returnflag = 'R' THEN 'DEVOLUCION' ELSE 'COMPRA' END AS tran_type,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS tran_valid_flg,
  CASE l_suppkey % 6 WHEN 0 THEN 'ch_a' WHEN 1 THEN 'CH_B' WHEN 2 THEN 'CH_C' WHEN 3 THEN 'CH_D' WHEN 4 THEN 'CH_E' ELSE NULL END AS channel_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Card CMR' WHEN '2-HIGH' THEN 'Deb card' WHEN '5-LOW' THEN NULL ELSE 'Cash' END AS payment_method_name
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey
"""

_REDEMPTIONS = """
SELECT o_custkey AS cust_id, l_orderkey * 10 + l_linenumber AS redemption_id_unico,
  CAST(l_shipdate AS DATE) AS redemption_date,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS mes,
  -CAST(l_quantity * 100 AS BIGINT) AS redemption_points_amt,
  CASE WHEN l_linenumber = 2 AND l_linestatus = 'F' THEN TRUE WHEN l_suppkey % 29 = 0 THEN NULL ELSE FALSE END AS return_flag,
  CASE l_partkey % 4 WHEN 0 THEN 'App' WHEN 1 THEN 'Tienda' WHEN 2 THEN 'Canal Digital' ELSE NULL END AS bu_channel_name,
  CASE l_partkey % 3 WHEN 0 THEN 'Catalogo' WHEN 1 THEN 'GiftCard' ELSE 'Servicio' END AS price_type_desc
FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linenumber <= 4
"""

_CAMPAIGNS = """
SELECT k, make_date(2000, k, 5) AS fecha_envio,
  concat('Camp Nro ', CAST(k AS STRING), '_05', lpad(CAST(k AS STRING), 2, '0'), '2000') AS nombre_campanha
FROM (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12)) AS t(k)
"""

# Campaign k reaches the customers of two market segments.
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_AUDIENCE = "SELECT * FROM (VALUES " + ", ".join(
    f"({k}, '{_SEGMENTS[(k + step) % 5]}')" for k in range(1, 13) for step in (0, 2)
) + ") AS t(camp, segment)"

# All joins are equi-joins of the customers with a few literal rows; some customers have a second window. Some have no address,
# a third of the others share one.
_SENDS = """
SELECT fecha_envio, nombre_campanha, c_custkey AS rut,
  CASE WHEN c_custkey % 5 = 0 THEN 'GC' ELSE 'GM' END AS gmgc,
  CASE c_custkey % 8 WHEN 7 THEN NULL WHEN 6 THEN 'OMP' WHEN 5 THEN 'OMP' ELSE 'BANCO' END AS tipo_cliente,
  CASE WHEN k % 2 = 0 THEN 'MAIL' ELSE 'PUSH' END AS canal, 'VIGENCIA' AS tipo_medicion,
  CASE WHEN k % 3 = 0 THEN 'TRIGGER' ELSE 'MASIVA' END AS tipo_campanha,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'shared@x.test' ELSE concat('c', CAST(c_custkey AS STRING), '@x.test') END AS email_corporativo,
  fecha_envio AS inicio_vigencia,
  fecha_envio + CAST(20 + w AS INT) AS fin_vigencia
FROM {customer}
JOIN {audience} ON c_mktsegment = segment
JOIN {campaigns} ON k = camp
JOIN (VALUES (0, 0), (1, 0), (1, 5)) AS v(second, w) ON second = CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END
"""

_MAIL_JOB = """
SELECT k AS id_jobenvio, fecha_envio AS fecha_real, CASE WHEN spelling = 0 THEN replace(nombre_campanha, ' ', '') ELSE nombre_campanha END AS desc_emailname
FROM {campaigns} JOIN (VALUES (0, 0), (1, 0), (1, 1)) AS v(twice, spelling) ON twice = CASE WHEN k % 6 = 1 THEN 1 ELSE 0 END
WHERE k % 4 <> 0
"""

_MAIL_SENT = """
SELECT k AS id_jobenvio, s.fecha_envio AS fecha_sent, s.fecha_envio AS fecha_real, email_corporativo AS email_cliente
FROM {sends} s JOIN {campaigns} c ON s.nombre_campanha = c.nombre_campanha
JOIN (VALUES (0, 0), (1, 0), (1, 1)) AS d(twice, dup) ON twice = CASE WHEN rut % 23 = 0 THEN 1 ELSE 0 END
WHERE gmgc = 'GM' AND tipo_cliente IS NOT NULL AND s.fin_vigencia = s.fecha_envio + 20
"""

# Feed rows count the sends of a campaign. Variant 1 is a second row of a campaign under another spelling or date.
_EMAIL_METRICS = """
SELECT CAST(k AS INT) AS id_jobenvio,
  CASE WHEN v = 1 AND k = 12 THEN 'Camp Nro 12_01011998' WHEN v = 1 THEN lower(nombre_campanha) WHEN k % 4 = 0 THEN concat(' camp  nro ', CAST(k AS STRING), '_31121999 ')
       WHEN k % 4 = 1 THEN upper(nombre_campanha) ELSE nombre_campanha END AS campaign_name,
  sent AS casos, fecha_envio AS inicio_vigencia, fecha_envio + 20 AS fin_vigencia, CAST(1 AS INT) AS flag_vigencia,
  replace(nombre_campanha, ' ', '') AS desc_emailname, concat('Asunto ', CAST(k AS STRING)) AS desc_asunto,
  CASE WHEN k = 7 THEN CAST(0 AS BIGINT) ELSE mails + 10 * v END AS total_mails,
  opens AS total_opens, clicks AS total_clicks, bounces AS total_bounces, unsubs AS total_unsubs,
  CAST(100.0 AS DOUBLE) AS porc_envio
FROM (SELECT nombre_campanha AS camp, count(*) AS sent,
        CAST(sum(CASE WHEN gmgc = 'GM' THEN 1 ELSE 0 END) AS BIGINT) AS mails,
        CAST(sum(CASE WHEN gmgc = 'GM' AND rut % 4 <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS opens,
        CAST(sum(CASE WHEN gmgc = 'GM' AND rut % 9 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
        CAST(sum(CASE WHEN gmgc = 'GM' AND rut % 31 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS bounces,
        CAST(sum(CASE WHEN gmgc = 'GM' AND rut % 97 = 4 THEN 1 ELSE 0 END) AS BIGINT) AS unsubs
      FROM {sends} GROUP BY nombre_campanha) s
JOIN {campaigns} ON camp = nombre_campanha
JOIN (VALUES (0, 0), (1, 0), (1, 1)) AS d(spelled, v) ON spelled = CASE WHEN k % 6 = 2 OR k = 12 THEN 1 ELSE 0 END
WHERE k <> 11
"""


class Fixtures:
    """The entities over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def clients(self) -> DataFrame:
        return self.spark.sql(_CLIENTS, customer=self.table("customer"), nation=self.table("nation"))

    def trx(self) -> DataFrame:
        return self.spark.sql(_TRX, orders=self.table("orders"), lineitem=self.table("lineitem"))

    def redemptions(self) -> DataFrame:
        return self.spark.sql(_REDEMPTIONS, orders=self.table("orders"), lineitem=self.table("lineitem"))

    def campaigns(self) -> DataFrame:
        """Twelve literal rows, so always broadcast."""
        return F.broadcast(self.spark.sql(_CAMPAIGNS))

    def sends(self) -> DataFrame:
        audience = F.broadcast(self.spark.sql(_AUDIENCE))
        return self.spark.sql(_SENDS, customer=self.table("customer"), audience=audience, campaigns=self.campaigns())

    def mail_job(self) -> DataFrame:
        return self.spark.sql(_MAIL_JOB, campaigns=self.campaigns())

    def mail_sent(self) -> DataFrame:
        return self.spark.sql(_MAIL_SENT, sends=self.sends(), campaigns=self.campaigns())

    def email_metrics(self) -> DataFrame:
        return self.spark.sql(_EMAIL_METRICS, sends=self.sends(), campaigns=self.campaigns())

    def snapshot_dates(self) -> list[dt.date]:
        """Calendar of the snapshots: send dates, both window ends, the month end before each send, the last day."""
        sends = [dt.date(2000, month, 5) for month in range(1, 13)]
        days = {dt.date(2000, 12, 31)}
        for day in sends:
            days |= {day, day + dt.timedelta(days=20), day + dt.timedelta(days=25), day.replace(day=1) - dt.timedelta(days=1)}
        return sorted(days)

    def funnel(self) -> DataFrame:
        """Customer state on each snapshot date, for customers enrolled by then.

        The last purchase and redemption up to a date come from per-customer lists with at most one date per
        snapshot, so no event is paired with every later snapshot.
        """
        snaps = F.array(*[F.lit(day) for day in self.snapshot_dates()])

        def last_dates(events: DataFrame, day: str, out: str) -> DataFrame:
            due = F.get(F.filter(snaps, lambda snap: snap >= F.col(day)), F.lit(0))
            latest = events.groupBy("cust_id", due.alias("due")).agg(F.max(day).alias("latest"))
            latest = latest.where(F.col("due").isNotNull())
            return latest.groupBy("cust_id").agg(F.collect_list("latest").alias(out))

        buys = last_dates(self.trx().where(F.col("tran_type") == "COMPRA"), "tran_date", "buys")
        redeems = last_dates(
            self.redemptions().where(F.col("return_flag") == F.lit(False)), "redemption_date", "redeems"
        )
        snap = F.col("partition_date")
        states = (
            self.clients()
            .join(buys, "cust_id", "left")
            .join(redeems, "cust_id", "left")
            .withColumn("partition_date", F.explode(F.filter(snaps, lambda day: day >= F.col("cust_enroll_date"))))
            .select(
                "partition_date",
                "cust_id",
                F.when(F.col("cust_id") % 13 < F.month(snap), "Normal").otherwise(F.col("cat_cust_name")).alias("loy_categoria"),
                F.array_max(F.filter("buys", lambda day: day <= snap)).alias("ultima_compra"),
                F.array_max(F.filter("redeems", lambda day: day <= snap)).alias("ultimo_canje"),
            )
        )

        def recent(day: str):
            long_tier = F.upper("loy_categoria").isin("ELITE", "PREMIUM")
            hit = (F.col(day) >= F.add_months(snap, -12)) | (long_tier & (F.col(day) >= F.add_months(snap, -24)))
            return F.when(hit, 1).otherwise(0)

        states = states.withColumn("ultima_fecha_pos_canje", F.when(F.col("cust_id") % 4 != 0, F.col("ultima_compra")))
        by_channel = lambda of, rest: F.when(F.col("cust_id") % of == rest, recent("ultima_compra")).otherwise(0)
        return states.select(
            "partition_date", "cust_id", "loy_categoria",
            F.when(F.col("cust_id") % 3 == 0, "OMP").otherwise("BANCO").alias("tipo_cliente"),
            recent("ultima_compra").alias("flag_acumulador"),
            by_channel(6, 1).alias("flag_acumulador_dig_3p"), by_channel(10, 3).alias("flag_acumulador_ikea"),
            recent("ultima_fecha_pos_canje").alias("flag_pos_canje_12_24m"),
            recent("ultimo_canje").alias("flag_canjeador_12_24m"),
            "ultima_compra", "ultima_fecha_pos_canje", "ultimo_canje",
        )
