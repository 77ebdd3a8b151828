"""Numbers of different customers that can be added up over cells, days and backfills.

Customers have dense codes, and a cell holds its customers as bitmaps of 32,768 codes each. Cells are rolled up by
uniting bitmaps, so a customer of two cells counts once, which sums of counts can't do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stampcard.operators.encoding import code_table, with_codes

_CODE = "_customer_code"


def customer_codes(rows: DataFrame, customer: str) -> DataFrame:
    """Dense code of each customer (``feature, label, code``), to be stored with the cube. Nulls have none."""
    return code_table(rows.select(customer), [customer])


def customer_bitmaps(rows: DataFrame, keys: list[str], customer: str, codes: DataFrame) -> DataFrame:
    """``keys, bucket, customers``: the customers of each cell by bucket of codes.

    Rows without a customer keep their cell, with an empty bitmap. A customer without a code would be lost, so it fails the job. Cells are united
    before and after the shuffle, so a hot cell brings one bitmap for each bucket and task.
    """
    coded = with_codes(rows.select(*keys, customer), codes, [customer], "_code")
    code = F.when(F.col(customer).isNotNull(), F.col(f"{customer}_code").cast("bigint"))
    sure = F.when(code < 0, F.raise_error(F.lit("customer without a code")).cast("bigint")).otherwise(code)
    placed = coded.select(*keys, sure.alias(_CODE))
    return placed.groupBy(*keys, F.coalesce(F.bitmap_bucket_number(_CODE), F.lit(1)).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(_CODE)).alias("customers")
    )


def united(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps of coarser cells, or of several backfills of the same cells; made with one table of codes."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("customers").alias("customers"))


def customers_by(bitmaps: DataFrame, keys: list[str], out: str = "CLIENTES") -> DataFrame:
    """Number of different customers by ``keys``, which are among those of the bitmaps."""
    counted = united(bitmaps, keys).select(*keys, F.bitmap_count("customers").alias("_n"))
    return counted.groupBy(*keys).agg(F.sum("_n").alias(out))
