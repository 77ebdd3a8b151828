"""Exact global order statistics, ranks, quantile bins and running totals without a global sort.

All of them share one idea: approximate percentiles give literal cut points, rows are counted per
bucket between cut points, and only then is anything ordered, inside one bucket. The cut points decide how
even the buckets are, never the result. A value that holds many rows would fill a bucket of its own, so
such values are cut again by the tie-break column.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, namedtuple
from functools import reduce
from itertools import accumulate
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

Position = namedtuple("Position", "position value tie")
_MIN_BUCKETS, _PIECES = 32, 16
#: Rows wanted in a bucket, and groups of rows whose percentiles are found apart and then combined.
BUCKET_ROWS, _GROUPS = 500_000, 16


def _bucket_count(rows: int, buckets: int | None) -> int:
    return max(2, buckets) if buckets else max(_MIN_BUCKETS, -(-rows // BUCKET_ROWS))


class _Cuts:
    """Literal cut points of one value column and its tie-break column."""

    def __init__(self, value_points: list[float], tie_points: list[float]):
        self.value_edges = _edges(value_points)
        self.tie_edges = _edges(tie_points)
        self.width = len(self.tie_edges) + 2
        # A percentile that repeats ``times`` marks a value holding about that many buckets' share of the rows. It is
        # cut by the tie-break into some 16 pieces per share, which keeps the number of buckets in the order of the
        # number of percentiles. Beyond 2**53 distinct integers share a double, so equality with a cut proves nothing.
        self.heavy: dict[int, list[float]] = {}
        for value, times in Counter(value_points).items():
            if times > 1 and abs(value) < 2**53:
                coarse = max(1, len(value_points) // (_PIECES * times))
                self.heavy.setdefault(1 << (coarse.bit_length() - 1), []).append(value)

    def add_bucket(self, df: DataFrame, value: str, tie: str | None, out: str) -> DataFrame:
        """Add an order-preserving bucket number; heavy values come first in their value bucket."""
        value_bucket, tie_bucket = f"{out}_v", f"{out}_t"
        df = bucketize(df, value, self.value_edges, value_bucket)
        sub = F.lit(self.width - 1)
        if tie is not None and self.heavy:
            df = bucketize(df, tie, self.tie_edges, tie_bucket)
            for step, values in self.heavy.items():
                piece = F.floor(F.col(tie_bucket) / step)
                listed = ", ".join(f"{v!r}D" for v in values)
                sub = F.when(F.expr(f"CAST(`{value}` AS DOUBLE) IN ({listed})"), piece).otherwise(sub)
        df = df.withColumn(out, (F.col(value_bucket) * self.width + sub).cast("bigint"))
        return df.drop(value_bucket, tie_bucket)


def _edges(points: list[float]) -> list[float]:
    """Distinct finite cut points; at least one, as a bucket needs two sides."""
    return sorted({point for point in points if isfinite(point)}) or [0.0]


def bucketize(df: DataFrame, column: str, edges: list[float], out: str) -> DataFrame:
    """Binary search of ``column`` in ``edges``; the bucket starts at its edge."""
    splits = [float("-inf"), *edges, float("inf")]
    source = f"{out}_in"
    marked = Bucketizer(splits=splits, inputCol=source, outputCol=out).transform(
        df.withColumn(source, F.col(column).cast("double"))
    )
    return marked.drop(source)


def _percentiles(column: str, buckets: int) -> Column:
    shares = ", ".join(f"{k / buckets!r}D" for k in range(1, buckets))
    return F.expr(f"percentile_approx(CAST(`{column}` AS DOUBLE), array({shares}), {max(10_000, 20 * buckets)})")


def _plan_cuts(df: DataFrame, values: list[str], tie: str | None, buckets: int | None) -> tuple[int, list[_Cuts]]:
    """Row count and cut points of all value columns.

    The number of buckets follows the rows. No task merges the sketches of all others: rows are dealt to a few groups by a hash, each group has its own
    percentiles, and the percentiles of these points, equally many a group, are the cut points.
    """
    rows = df.count()
    if rows == 0:
        return 0, []
    parts = _bucket_count(rows, buckets)
    names = {f"v{i}": name for i, name in enumerate(values)} | ({"t": tie} if tie else {})
    group = F.pmod(F.xxhash64(*dict.fromkeys([*values, *([tie] if tie else [])])), F.lit(_GROUPS))
    by_group = df.groupBy(group.alias("_group")).agg(*[_percentiles(name, parts).alias(k) for k, name in names.items()])
    points = by_group.select(F.inline(F.arrays_zip(*[F.col(k) for k in names])))
    row = points.agg(*[_percentiles(k, parts).alias(k) for k in names]).first()
    return rows, [_Cuts(row[f"v{i}"], row["t"] if tie else []) for i in range(len(values))]


def order_statistics_many(df: DataFrame, values: list[str], tie: str, positions_of, buckets: int | None = None):
    """Rows at exact positions of the order (value, tie), for several value columns at once.

    ``positions_of(n)`` names the 1-based positions wanted among ``n`` rows. Returns ``n`` and, per
    value column, the wanted positions with their value and tie-break. Values must not be null. Two light
    passes cover all columns, a third reads only the buckets that hold a wanted position.
    """
    df = df.select(*dict.fromkeys([*values, tie]))
    n, cuts = _plan_cuts(df, values, tie, buckets)
    positions = positions_of(n) if n else []
    if not positions:
        return n, [[] for _ in values]
    marked = df
    for i, name in enumerate(values):
        marked = cuts[i].add_bucket(marked, name, tie, f"_b{i}")
    pairs = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"_b{i}").alias("bucket")) for i in range(len(values))])
    sizes = marked.select(F.inline(pairs)).groupBy("dim", "bucket").count().collect()

    wanted_of, reads = [], []
    for i, name in enumerate(values):
        ordered = sorted((row.bucket, row["count"]) for row in sizes if row.dim == i)
        ends = list(accumulate(count for _, count in ordered))
        wanted = {}
        for position in positions:
            at = bisect_left(ends, position)
            wanted[(ordered[at][0], position - (ends[at - 1] if at else 0))] = position
        inside = Window.partitionBy(f"_b{i}").orderBy(name, tie)
        targets = ", ".join(f"({bucket}L, {rank})" for bucket, rank in wanted)
        wanted_of.append(wanted)
        reads.append(
            marked.where(F.col(f"_b{i}").isin([bucket for bucket, _ in wanted]))
            .withColumn("_rn", F.row_number().over(inside))
            .where(F.expr(f"(`_b{i}`, _rn) IN ({targets})"))
            .select(F.lit(i).alias("dim"), F.col(f"_b{i}").alias("bucket"), F.col("_rn").alias("rn"),
                    F.col(name).alias(f"v{i}"), F.col(tie).alias("t"))
        )
    hits: list[dict] = [{} for _ in values]
    for row in reduce(lambda one, more: one.unionByName(more, allowMissingColumns=True), reads).collect():
        hits[row.dim][wanted_of[row.dim][(row.bucket, row.rn)]] = Position(None, row[f"v{row.dim}"], row.t)
    return n, [[hits[i][p]._replace(position=p) for p in positions] for i in range(len(values))]


def order_statistics(df: DataFrame, value: str, tie: str, positions: list[int], buckets: int | None = None):
    """Rows at the given 1-based positions of the order (value, tie)."""
    return order_statistics_many(df, [value], tie, lambda n: positions, buckets)[1][0]


def exact_quantile(df: DataFrame, value: str, tie: str, shares: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation between neighbours; nulls are left out."""
    df = df.where(F.col(value).isNotNull())

    def around(n):
        spots = set()
        for share in shares:
            low, _ = _spot(n, share)
            spots |= {low, min(low + 1, n)}
        return sorted(spots)

    n, (hits,) = order_statistics_many(df, [value], tie, around)
    at = {hit.position: float(hit.value) for hit in hits}
    out = []
    for share in shares if n else []:
        low, weight = _spot(n, share)
        here, after = at[low], at[min(low + 1, n)]
        out.append(here + (after - here) * weight)
    return out


def _spot(n: int, share: float) -> tuple[int, float]:
    """1-based lower neighbour and weight of the upper one."""
    exact = (n - 1) * share
    return 1 + int(exact), exact - int(exact)


def _after(value: str, tie: str, hit: Position) -> Column:
    """True where the row comes after ``hit`` in the order (value, tie)."""
    same = F.col(value) == F.lit(hit.value)
    return ((F.col(value) > F.lit(hit.value)) | (same & (F.col(tie) > F.lit(hit.tie)))).cast("int")


def quintiles(df: DataFrame, scores: dict[str, tuple[str, bool]], tie: str, buckets: int | None = None) -> DataFrame:
    """Add 1..5 scores of unique ranks; ``scores`` maps output name to (value column, ascending).

    Bin k ends at rank ``1 + floor(k * (n - 1) / 5)``, so only four rows per column need to be known and
    scoring is a comparison with literals: no row of ``df`` is shuffled. A single row scores 3.
    """
    values = [value for value, _ in scores.values()]

    def bin_ends(n):
        return sorted({1 + k * (n - 1) // 5 for k in range(1, 5)}) if n > 1 else []

    n, hits = order_statistics_many(df, values, tie, bin_ends, buckets)
    added = {}
    for (out, (value, ascending)), found in zip(scores.items(), hits):
        if n <= 1:
            added[out] = F.lit(3)
            continue
        at = {hit.position: hit for hit in found}
        rank_bin = F.lit(1)
        for k in range(1, 5):
            rank_bin = rank_bin + _after(value, tie, at[1 + k * (n - 1) // 5])
        added[out] = rank_bin if ascending else F.lit(6) - rank_bin
    return df.withColumns(added)


def quantile_edges(df: DataFrame, value: str, tie: str, bins: int) -> list[float]:
    """Distinct edges of equal-share bins over the value itself."""
    return sorted(set(exact_quantile(df, value, tie, [k / bins for k in range(bins + 1)])))


def quantile_bins(df: DataFrame, value: str, tie: str, bins: int = 10, out: str = "decile") -> DataFrame:
    """0-based, right-closed quantile bins; equal edges merge, so ties share a bin."""
    inner = quantile_edges(df, value, tie, bins)[1:-1]
    number = F.lit(0)
    for edge in inner:
        number = number + (F.col(value) > F.lit(edge)).cast("int")
    return df.withColumn(out, number)


def distributed_rank(df: DataFrame, value: str, tie: str, out: str = "rn", buckets: int | None = None) -> DataFrame:
    """Unique 1-based rank of the order (value, tie): one exchange by bucket, none into one partition.

    Null and NaN values have no rank.
    """
    unknown = F.col(value).isNull()
    if dict(df.dtypes)[value] in ("double", "float"):
        unknown = unknown | F.isnan(value)
    ranked = _ranked(df.where(~unknown), value, tie, out, buckets)
    return ranked.unionByName(df.where(unknown).withColumn(out, F.lit(None).cast("bigint")))


def _ranked(df: DataFrame, value: str, tie: str, out: str, buckets: int | None) -> DataFrame:
    n, cuts = _plan_cuts(df, [value], tie, buckets)
    if n == 0:
        return df.withColumn(out, F.lit(None).cast("bigint"))
    marked = cuts[0].add_bucket(df, value, tie, "_bucket")
    sizes = sorted((row["_bucket"], row["count"]) for row in marked.groupBy("_bucket").count().collect())
    starts = [0, *accumulate(count for _, count in sizes)]
    offsets = df.sparkSession.createDataFrame(
        [(bucket, start) for (bucket, _), start in zip(sizes, starts)], "_bucket BIGINT, _before BIGINT"
    )
    inside = Window.partitionBy("_bucket").orderBy(value, tie)
    return (
        marked.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_before") + F.col("_rn"))
        .drop("_bucket", "_before", "_rn")
    )


def running_totals(df: DataFrame, value: str, sums: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``<name>_upto``, the total of ``name`` over rows with a value up to this one.

    ``df`` holds one row per value. Bucket totals are at most one row per bucket and travel as a small
    broadcast table.
    """
    n, cuts = _plan_cuts(df, [value], None, buckets)
    if n == 0:
        return df.withColumns({f"{name}_upto": F.lit(None).cast("bigint") for name in sums})
    marked = cuts[0].add_bucket(df, value, None, "_bucket")
    totals = sorted(marked.groupBy("_bucket").agg(*[F.sum(name).alias(name) for name in sums]).collect())
    running, before = [0] * len(sums), []
    for row in totals:
        before.append((row["_bucket"], *running))
        running = [total + row[name] for total, name in zip(running, sums)]
    ddl = ", ".join(["_bucket BIGINT", *[f"_before_{name} BIGINT" for name in sums]])
    offsets = df.sparkSession.createDataFrame(before, ddl)
    inside = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.withColumns({f"_in_{name}": F.sum(name).over(inside) for name in sums})
    joined = summed.join(F.broadcast(offsets), "_bucket")
    joined = joined.withColumns({f"{name}_upto": F.col(f"_in_{name}") + F.col(f"_before_{name}") for name in sums})
    return joined.drop("_bucket", *[f"_in_{name}" for name in sums], *[f"_before_{name}" for name in sums])
