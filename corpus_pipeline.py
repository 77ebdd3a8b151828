"""A cleaning pipeline over ``documents``: quality rules, line dedup, near-duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns of
``documents``. ``run`` writes each stage to the shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stampcard.llm import bpe, contamination, lines, quality, simhash
from stampcard.llm.common import bound_batches, table
from stampcard.session import materialize

#: Edit similarity, hash components and merges are not expressible in SQL; the tests hold ``run`` against a plain version.
ORACLE_SQL = None


def stage(build: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose texts reach Python in batches of bounded size: workers live through all stages, and each keeps the memory of its largest batch."""
    @wraps(build)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return build(spark, docs, sf_dir)

    return bounded


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality.ledger(docs).where(quality.verdict()).select(*docs.columns)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document has; ``n_chars`` follows a changed text. A text may become empty."""
    done = lines.dedup_lines(docs)
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.withColumn("n_chars", chars).select(*docs.columns)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within 4 bits (shingles of 4 words): the smallest id, a null id only if there is no other."""
    return simhash.keep_one(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return contamination.mark(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    rules = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), *rules, bytes_col="decoded")
    intact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", intact.alias("intact"))


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, build in STAGES:
        docs = materialize(build(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
