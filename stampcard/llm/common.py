"""Helpers shared by the text operators: row keys, Arrow columns, runs of sorted keys, state of a worker."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handled in slices of about this many bytes, so that a task's memory does not follow the batch size.
SLICE_BYTES = 2 << 20
#: Arrow batches that Spark sends to Python, else 10,000 rows whatever they hold: both sides keep a batch whole, and a worker does not give it back.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound this session's Arrow batches by bytes, unless it does so already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit key of a row by id and text: rows that repeat both are one document, rows that share only the id are not."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def hashed_share(key: str, most: int, total: int) -> Column:
    """True for about ``most`` of ``total`` rows, chosen by a hash of the key: the same rows each time, without a sort."""
    space = 1 << 30
    return F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(space)) < F.lit(space if total <= most else space * most // total)


def worker_state(key: tuple, build: Callable[[], object]) -> object:
    """``build()`` once in each Python worker, however many tasks it runs."""
    kept = sys.modules.setdefault("_stampcard_worker_state", types.ModuleType("_stampcard_worker_state")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def text_slices(batches: Iterable[pa.RecordBatch], text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text; a row is never cut."""
    for batch in batches:
        column = batch.column(text_col)
        sizes = np.zeros(batch.num_rows, np.int64)
        if batch.num_rows:
            sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def slices(batches: Iterable[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with the texts as strings (null as empty)."""
    for part in text_slices(batches, text_col):
        yield part, [t or "" for t in part.column(text_col).to_pylist()]


def add_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[list[str]], list[pa.Array]]) -> DataFrame:
    """``df`` with columns that ``make`` computes from the texts; columns of the same names are replaced."""
    names = {f.name.lower() for f in fields}
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names or c == text_col])
    if text_col.lower() in names:
        raise ValueError(f"the text column can't be named {text_col}")
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text_col):
            arrays = [*part.columns, *make(texts)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)


def key_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of equal key from a stream sorted by it, one table per key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of ``counts`` elements each, cut from ``flat``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
