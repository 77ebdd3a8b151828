"""Which customer a send is measured on: matching of sends to e-mail jobs and deliveries.

Deliveries can repeat and customers can share an address, so matches fan out. The operators carry the number
of matches as a weight instead of emitting the matching pairs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from stampcard.functions.text import squash
from stampcard.session import materialize

_MATCH = ["name_key", "email", "fecha_envio"]
_SEND = ["fecha_envio", "nombre_campanha", "tipo_cliente", "gmgc", "inicio_vigencia", "fin_vigencia"]


def mail_campaigns(mail: DataFrame, jobs: DataFrame, start: dt.date) -> DataFrame:
    """Deliveries with the campaign name of their job; deliveries without a job of the range drop out."""
    sent = mail.where(F.col("fecha_real") >= F.lit(start))
    named = jobs.where(F.col("fecha_real") >= F.lit(start)).select("id_jobenvio", "fecha_real", "desc_emailname")
    return sent.join(named, ["id_jobenvio", "fecha_real"]).select(
        "id_jobenvio", "fecha_sent", "fecha_real", "email_cliente", "desc_emailname"
    )


def campaign_mail_match(sends: DataFrame, mail: DataFrame, jobs: DataFrame, start: dt.date) -> DataFrame:
    """Per campaign and send date: 1 if any job name matches after removing spaces, and the number of different
    spellings that do (at least 1).

    Deliveries shrink to distinct (job, day) pairs before they meet the jobs.
    """
    days = mail.select("id_jobenvio", "fecha_real", "fecha_sent", F.lit("").alias("email_cliente")).distinct()
    named = mail_campaigns(days, jobs, start).where(F.col("desc_emailname").isNotNull())
    matched = named.select(
        squash(F.col("desc_emailname")).alias("name_key"), F.col("fecha_sent").alias("fecha_envio"), F.col("desc_emailname").alias("spelling")
    )
    campaigns = sends.select("fecha_envio", "nombre_campanha").distinct()
    keyed = campaigns.withColumn("name_key", squash(F.col("nombre_campanha")))
    found = matched.groupBy("name_key", "fecha_envio").agg(F.countDistinct("spelling").alias("_n"))
    return keyed.join(found, ["name_key", "fecha_envio"], "left").select(
        "nombre_campanha", "fecha_envio", F.when(F.col("_n") > 0, 1).otherwise(0).alias("cruce_camp"),
        F.coalesce("_n", F.lit(1)).cast("bigint").alias("spellings"),
    )


def deliveries_per_address(mail: DataFrame, jobs: DataFrame, start: dt.date) -> DataFrame:
    """Number of deliveries per squashed name, address and day.

    Jobs are few and normally broadcast by their size. Where they are not, a job with a large share of the
    mails is a skewed join key, which adaptive execution splits, as the grouping after it shuffles anyway.
    """
    return mail_campaigns(mail.where(F.col("email_cliente").isNotNull()), jobs, start).groupBy(
        squash(F.col("desc_emailname")).alias("name_key"),
        F.col("email_cliente").alias("email"),
        F.col("fecha_sent").alias("fecha_envio"),
    ).agg(F.count(F.lit(1)).alias("deliveries"))


def _keyed(sends: DataFrame) -> DataFrame:
    return sends.withColumn("name_key", squash(F.col("nombre_campanha"))).withColumnRenamed("email_corporativo", "email")


def recipient_match(sends: DataFrame, mail: DataFrame, jobs: DataFrame, start: dt.date) -> DataFrame:
    """Sends delivered by mail, one row per distinct send with the number of matching pairs."""
    kept = ["canal", "tipo_medicion", "tipo_campanha", "fecha_envio", "nombre_campanha", "tipo_cliente", "rut"]
    rows = _keyed(sends).groupBy(*kept, "name_key", "email").agg(F.count(F.lit(1)).alias("n_sends"))
    matched = rows.join(deliveries_per_address(mail, jobs, start), _MATCH)
    return matched.select(*kept, "email", (F.col("n_sends") * F.col("deliveries")).alias("n_matches"))


def _counted_sends(sends: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Distinct sends of the range with their count."""
    ranged = _keyed(sends.where(F.col("fecha_envio").between(F.lit(start), F.lit(end))))
    return ranged.groupBy(*_SEND, "name_key", "email", "rut").agg(F.count(F.lit(1)).alias("n"))


def _reached(rows: DataFrame, mail: DataFrame, jobs: DataFrame, start: dt.date) -> DataFrame:
    """Addresses that mails reached: deliveries, number of matching pairs, and whether one customer is there.

    A send without a customer counts as another customer.
    """
    alone = (F.min("rut") == F.max("rut")) & (F.count("rut") == F.count(F.lit(1)))
    per_address = rows.where(F.col("email").isNotNull()).groupBy(*_MATCH).agg(
        F.sum("n").alias("n_sends"), F.coalesce(alone, F.count("rut") == 0).alias("one_customer")
    )
    return per_address.join(deliveries_per_address(mail, jobs, start), _MATCH).select(
        *_MATCH, "deliveries", "one_customer", (F.col("n_sends") * F.col("deliveries")).alias("n_matches")
    )


def identity_rows(sends: DataFrame, mail: DataFrame, jobs: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Measured customer and weight per send; a customer reached at several addresses has several rows.

    Sends without an address can match nothing, so each gets a key of its own and they spread over all tasks. The
    reached addresses are stored, which leaves both sides of their join to be shuffled for it: adaptive execution then
    splits an address that many sends share. Sends at an address of one customer, nearly all of them, keep that
    customer and need no further join.
    """
    rows = _counted_sends(sends, start, end)
    reached = materialize(_reached(rows, mail, jobs, start), "reached-addresses")
    spread = F.coalesce("email", F.concat(F.lit("\0"), F.col("rut").cast("string")))
    tagged = materialize(rows.withColumn("_email", spread).join(reached.withColumnRenamed("email", "_email"), ["name_key", "_email", "fecha_envio"], "left"), "tagged-sends")
    campaigns = campaign_mail_match(sends.where(F.col("fecha_envio").between(F.lit(start), F.lit(end))), mail, jobs, start)
    treated = F.coalesce(F.col("gmgc") == "GM", F.lit(False))
    moved = treated & F.col("n_matches").isNotNull() & ~F.coalesce("one_customer", F.lit(True))
    own = tagged.where(~moved).select(
        *_SEND, F.col("rut").alias("rut_medicion"), (F.col("n") * F.coalesce("n_matches", F.lit(1))).alias("weight")
    )
    shared = tagged.where(F.col("n_matches").isNotNull() & ~F.col("one_customer"))
    customers = shared.groupBy(*_MATCH, F.col("rut").alias("rut_medicion")).agg(
        (F.sum("n") * F.max("deliveries")).alias("n_reached")
    )
    per_address = tagged.where(moved).groupBy(*_SEND, "name_key", "email").agg(F.sum("n").alias("n"))
    shifted = per_address.join(customers.where(F.col("rut_medicion").isNotNull()), _MATCH).select(
        *_SEND, "rut_medicion", (F.col("n") * F.col("n_reached")).alias("weight")
    )
    # a match with an unknown customer leaves the send with its own
    unknown = customers.where(F.col("rut_medicion").isNull()).select(*_MATCH, "n_reached")
    kept = tagged.where(moved).join(unknown, _MATCH).select(
        *_SEND, F.col("rut").alias("rut_medicion"), (F.col("n") * F.col("n_reached")).alias("weight")
    )
    # a row per campaign at most; a join by campaign would bring all sends of one into one task
    spelled = F.broadcast(campaigns.where(F.col("spellings") > 1).select("nombre_campanha", "fecha_envio", "spellings"))
    every = own.unionByName(shifted).unionByName(kept).join(spelled, ["nombre_campanha", "fecha_envio"], "left")
    return every.select(*_SEND, "rut_medicion", (F.col("weight") * F.coalesce("spellings", F.lit(1))).alias("weight"))


def measurement_identity(sends: DataFrame, mail: DataFrame, jobs: DataFrame, start: dt.date, end: dt.date,
                         dedupe: bool = False) -> DataFrame:
    """Sends with the customer they are measured on (``rut_medicion``) and a fan-out ``weight``.

    A treated send of a campaign that was mailed is measured on every customer reached at its address, others
    on their own customer. An address match implies that the campaign was mailed that day. A campaign mailed under several
    spellings of its name counts once for each. The weight is the number of rows a row-by-row match would give; treated sends are
    counted per address before they meet the customers reached there, so an address shared by many customers gives
    one row per customer, not one per pair. ``dedupe=True`` sets all weights to 1.
    """
    rows = identity_rows(sends, mail, jobs, start, end)
    merged = rows.groupBy(*_SEND, "rut_medicion").agg(F.sum("weight").alias("weight"))
    return merged.withColumn("weight", F.lit(1).cast("bigint")) if dedupe else merged
