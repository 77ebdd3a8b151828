"""Stored datasets shared by the queries: built once per session and data folder, then scanned.

Reports read cubes that are rebuilt by a job, not recomputed per report; this module does the same for the
benchmark tables.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from stampcard.fixtures import CHANNELS, END, SPEND, START, T0, Fixtures
from stampcard.operators import attribution, distinct, features, lifecycle, metrics, rfm, validity
from stampcard.plans.jobs import Entities
from stampcard.session import ROWS_PER_PARTITION, materialize, spread_by_rows


class Sizes(NamedTuple):
    """Line items, the bytes that one takes in its file, and customers."""

    items: int
    item_bytes: float
    customers: int


_stored: dict[tuple[str, str, str], DataFrame] = {}
_rows: dict[tuple[str, str], Sizes] = {}


def synthetic_score():
    """A deterministic stand-in for the score of an earlier model, built from customer features."""
    redeems, buys, idle = F.col("redeem_count_pre"), F.col("frequency_total"), F.col("recency_days")
    return F.least(F.lit(1.0), (redeems + F.lit(1.0)) / (buys + F.lit(12.0) + idle * F.lit(0.125)))


class Marts(Fixtures):
    """Fixture entities plus the stored datasets derived from them."""

    def _store(self, name: str, build: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored:
            _stored[key] = materialize(build(), name, partition_by)
        return _stored[key]

    def spread(self) -> Marts:
        """Partitions by the rows of the largest tables: shuffles by the line items, or a state of each customer and snapshot day; scans by the line items."""
        key = self.spark.sparkContext.applicationId, self.sf_dir
        if key not in _rows:
            files = super().table("lineitem").groupBy("_metadata.file_path", "_metadata.file_size").count()
            items = files.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.sum("file_size").alias("bytes")).first()
            _rows[key] = Sizes(items.n, (items.bytes or 0) / max(1, items.n), super().table("customer").count())
        sizes = _rows[key]
        spread_by_rows(self.spark, max(sizes.items, sizes.customers * len(self.snapshot_dates())), sizes.item_bytes)
        return self

    def table(self, name: str) -> DataFrame:
        """A customer becomes a dozen sends and states in the task that reads it, so many customers are dealt to as many tasks as their rows ask for."""
        df, sizes = super().table(name), _rows.get((self.spark.sparkContext.applicationId, self.sf_dir))
        if name != "customer" or not sizes or sizes.customers <= ROWS_PER_PARTITION:
            return df
        return df.repartition(-(-sizes.customers // ROWS_PER_PARTITION))

    def entities(self) -> Entities:
        return Entities(self.clients(), self.trx(), self.redemptions(), self.sends(), self.mail_sent(), self.mail_job(),
                        self.snapshots())

    def snapshots(self) -> DataFrame:
        return self._store("snapshots", self.funnel, ["partition_date"])

    def calendar(self) -> DataFrame:
        return self._store("calendar", lambda: validity.snapshot_calendar(self.snapshots()))

    def state_intervals(self) -> DataFrame:
        return self._store("state-intervals", lambda: validity.state_intervals(self.snapshots(), self.calendar()))

    def redeemer_intervals(self) -> DataFrame:
        def build() -> DataFrame:
            states = lifecycle.canjeador(validity.month_end_asof(self.state_intervals(), self.calendar(), START))
            return validity.state_intervals(states.select("partition_date", "cust_id", "tipo_canjeador"), self.calendar())

        return self._store("redeemer-intervals", build)

    def features(self) -> DataFrame:
        build = lambda: features.customer_features(self.clients(), self.trx(), self.redemptions(), T0, CHANNELS)
        return self._store("features", build)

    def rfm(self) -> DataFrame:
        build = lambda: rfm.rfm_table(self.features(), SPEND).withColumn("propensity_score", synthetic_score())
        return self._store("rfm", build)

    def customer_cells(self) -> DataFrame:
        """Cells and customers of ``metrics``, which are counted both ways: by rows and as bitmaps."""
        return self._store("customer-cells", lambda: metrics.customer_cells(metrics.cube_rows(
            self.sends(), self.redemptions(), self.snapshots(), self.mail_sent(), self.mail_job(), START, END
        )))

    def metrics(self) -> DataFrame:
        return self._store("metrics", lambda: metrics.counted_cells(self.customer_cells()))

    def cube_customers(self) -> DataFrame:
        """Customers of each cell of ``metrics`` as bitmaps."""
        def build() -> DataFrame:
            rows = self.customer_cells().select(*metrics.CUBE_KEYS, "rut_medicion")
            return distinct.customer_bitmaps(rows, metrics.CUBE_KEYS, "rut_medicion", distinct.customer_codes(rows, "rut_medicion"))

        return self._store("cube-customers", build)

    def attributed(self) -> DataFrame:
        build = lambda: metrics.score_attributed(
            attribution.attribute_redemptions(self.sends(), self.redemptions(), START, END), self.rfm(), rfm.NO_SCORE
        )
        return self._store("attributed", build)

    def rfm_cube(self) -> DataFrame:
        return self._store("rfm-cube", lambda: metrics.rfm_campaigns(self.attributed()))

    def email(self) -> DataFrame:
        return self._store("email", self.email_metrics)

    def outcomes(self) -> DataFrame:
        build = lambda: attribution.attribute_redemptions_horizon(self.sends(), self.redemptions(), START, END)
        return self._store("outcomes", build)
