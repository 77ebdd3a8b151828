"""Second-order boosted trees for a binary label, grown level by level over binned rows.

Inputs are cut once into bins at approximate quantiles, and the rows are stored as bin numbers, in blocks. For each level of a tree one job
sums the first and second derivatives of the loss by (node, input, bin): each task over its cached blocks, many tasks' sums in a tree. What
reaches the driver is a few sets of histograms, each of at most ``2^(depth - 2) * inputs * bins`` cells, whatever the number of rows: of two
siblings only the one with less weight is summed, as the other one's sums are what it leaves of their parent's. Rows that are one partition (``FEW_ROWS`` at most) need no job a level, as their task has the whole sums: it goes on to the next
level and tree. The split of each node is chosen from the sums by the gain of second-order boosting with L1 and L2 penalties and a least gain:

    score(G, H) = shrink(G, l1)^2 / (H + l2),   gain = score(left) + score(right) - score(node),   leaf = -shrink(G, l1) / (H + l2)

Rows and inputs are drawn anew for each tree: rows by a hash of their number, inputs by the seed. A row's margin is stored every
``STORE_EVERY`` trees and cached every ``HOLD_EVERY``, so a job applies few trees; a lost executor costs the trees since the last write, for its rows.
Ties between splits go to the first input, then the lowest bin.
"""

from __future__ import annotations

import random
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stampcard.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no install of it

#: Trees between two writes of the margins; trees between two cached copies of them.
STORE_EVERY, HOLD_EVERY = 25, 5
#: Rows of a block; partitions whose sums the driver adds up itself.
BLOCK_ROWS, FEW_TASKS = 32_768, 48
#: Rows of a task where one task a core would have more. Smaller tasks do not shorten a level: what its job takes grows with their number.
TASK_ROWS = 1_000_000
#: Rows that stay one partition: a task sums them for a level in less time than a job takes (a tree of 330,000 rows 0.14 s, in six jobs 0.6 s).
FEW_ROWS = 500_000


@dataclass(frozen=True)
class Settings:
    trees: int = 500
    depth: int = 6
    rate: float = 0.03
    rows: float = 0.9
    columns: float = 0.6
    child_weight: float = 5.0
    gamma: float = 0.1
    l1: float = 0.5
    l2: float = 0.01
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Nodes as arrays; node ``k`` has the children ``2k + 1`` and ``2k + 2``. A leaf has input -1 and a value."""

    inputs: np.ndarray
    cuts: np.ndarray
    values: np.ndarray
    gains: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row (a row of bin numbers) has reached after that many levels."""
        at, first, flat = np.zeros(len(bins), np.int64), np.arange(len(bins)) * bins.shape[1], bins.ravel()
        for _ in range(depth):
            at = self.step(at, first, flat)
        return at

    def step(self, at: np.ndarray, first: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The nodes one level further. ``flat``: bin numbers of all rows, ``first``: where each row's begin."""
        split = self.inputs.take(at)
        inside = split >= 0
        right = flat.take(first + np.maximum(split, 0)) > self.cuts.take(at)
        return np.where(inside, 2 * at + 1 + right, at)

    def filled(self, depth: int) -> Tree:
        """The same tree with all leaves on the last level: a leaf above sends every row to the left, and hands down its value."""
        out = Tree(self.inputs.copy(), self.cuts.copy(), self.values.copy(), self.gains)
        for node in range((1 << depth) - 1):
            if out.inputs[node] < 0:
                out.inputs[node], out.cuts[node] = 0, 255
                out.inputs[2 * node + 1], out.values[2 * node + 1] = -1, out.values[node]
        return out


def shrink(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def score(g, h, s: Settings):
    return shrink(g, s.l1) ** 2 / (h + s.l2)


def bin_edges(df: DataFrame, inputs: list[str], bins: int) -> list[np.ndarray]:
    """Cut points of each input: different approximate quantiles, the greatest value left out."""
    shares = ", ".join(f"{k / bins!r}D" for k in range(1, bins))
    wanted = [F.expr(f"percentile_approx(`{name}`, array({shares}), {20 * bins})").alias(f"p{k}") for k, name in enumerate(inputs)]
    tops = [F.max(name).alias(f"m{k}") for k, name in enumerate(inputs)]
    row = df.agg(*wanted, *tops).first()
    return [np.array(sorted({x for x in (row[f"p{k}"] or []) if x < row[f"m{k}"]})) for k in range(len(inputs))]


def _matrix(batch: pa.RecordBatch, inputs: list[str], edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: how many cut points lie below the value."""
    columns = [np.searchsorted(e, np.asarray(batch.column(name).cast(pa.float64()))) for name, e in zip(inputs, edges)]
    return np.stack(columns, axis=1).astype(np.uint8)


def _binned_rows(batches: Iterable[pa.RecordBatch], inputs: list[str], edges: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        yield np.asarray(batch.column("number")), np.asarray(batch.column("label")), _matrix(batch, inputs, edges)


def _joined(parts: Iterable[tuple[np.ndarray, ...]], rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows in parts of ``rows`` at least, but for the last one."""
    held: list[tuple[np.ndarray, ...]] = []
    for part in parts:
        held.append(part)
        if sum(len(x[0]) for x in held) >= rows:
            yield tuple(map(np.concatenate, zip(*held)))
            held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _drawn(numbers: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """Whether a row takes part in a tree, by a mixed hash of its number."""
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((s.seed << 32) + tree)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64 < s.rows


def drawn_inputs(n: int, tree: int, s: Settings) -> list[int]:
    return sorted(random.Random(f"{s.seed}:{tree}").sample(range(n), max(1, int(s.columns * n))))


def margins(bins: np.ndarray, trees: list[Tree], s: Settings) -> np.ndarray:
    return filled_margins(bins, [tree.filled(s.depth) for tree in trees], s)


def filled_margins(bins: np.ndarray, trees: list[Tree], s: Settings) -> np.ndarray:
    out = np.zeros(len(bins))
    first, flat = np.arange(len(bins)) * bins.shape[1], bins.ravel()
    for tree in trees:
        at = np.zeros(len(bins), np.int64)
        for _ in range(s.depth):
            at = 2 * at + 1 + (flat.take(first + tree.inputs.take(at)) > tree.cuts.take(at))
        out += s.rate * tree.values.take(at)
    return out


def derivatives(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return p - label, np.maximum(p * (1.0 - p), 1e-16)


_PARTS = ("number", "label", "margin", "recent", "bins")
_BLOCK = T.StructType([T.StructField(c, T.BinaryType()) for c in _PARTS])
_TYPES = (np.int64, np.float64, np.float64, np.float64, np.uint8)


def _packed(*parts: np.ndarray) -> tuple[bytes, ...]:
    return tuple(np.ascontiguousarray(x, kind).tobytes() for x, kind in zip(parts, _TYPES))


def _unpacked(block: tuple, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, labels, margins when last stored, what trees added since then, and bin numbers of a block of rows."""
    number, label, margin, recent, bins = (np.frombuffer(x, kind) for x, kind in zip(block, _TYPES))
    return number, label, margin, recent, bins.reshape(-1, width)


def grown(recent: np.ndarray, bins: np.ndarray, since: list[Tree], s: Settings) -> np.ndarray:
    """What trees added to the margins, with some more trees; added up in the order of the trees."""
    for tree in since:
        recent = recent + s.rate * tree.values[tree.nodes(bins, s.depth)]
    return recent


def part_sums(part: Iterable[tuple], width: int, since: list[Tree], tree: Tree, level: int, number: int, chosen: list[int], open_nodes: list[int], s: Settings) -> np.ndarray:
    """Sums of both derivatives over the rows of blocks, by open node, chosen input and bin."""
    sums = np.zeros((2, len(open_nodes), len(chosen), s.bins))
    asked = np.isin(np.arange((2 << s.depth) - 1), open_nodes)
    for block in part:
        numbers, label, margin, recent, bins = _unpacked(block, width)
        at = tree.nodes(bins, level)
        rows = np.flatnonzero(asked.take(at) & _drawn(numbers, number, s))
        kept = bins.take(rows, axis=0)
        g, h = derivatives(margin[rows] + grown(recent[rows], kept, since, s), label[rows])
        sums += node_sums(at.take(rows), np.ascontiguousarray(kept[:, chosen].T), g, h, open_nodes, s)
    return sums


def node_sums(at: np.ndarray, columns: np.ndarray, g: np.ndarray, h: np.ndarray, open_nodes: list[int], s: Settings) -> np.ndarray:
    """Sums of both derivatives of rows by open node, input and bin; ``columns``: a row of bin numbers for each input."""
    place = np.full((2 << s.depth) - 1, len(open_nodes))
    place[open_nodes] = np.arange(len(open_nodes))
    spot = place.take(at)
    here = np.flatnonzero(spot < len(open_nodes))
    some = len(here) < len(at)  # rows of other nodes are left out
    if some:
        spot, g, h = spot.take(here), g.take(here), h.take(here)
    first = spot * s.bins
    sums = np.empty((2, len(open_nodes), len(columns), s.bins))
    for k, column in enumerate(columns):  # an input at a time, so that what is read and written stays in the processor's caches
        cells = first + (column.take(here) if some else column)
        for kind, weights in enumerate((g, h)):
            sums[kind, :, k] = np.bincount(cells, weights, len(open_nodes) * s.bins).reshape(-1, s.bins)
    return sums


def level_sums(blocks: RDD, *asked) -> np.ndarray:
    """``part_sums`` of all blocks: each task adds up its own; many tasks' sums meet in a tree, so the driver gets the sums of few."""
    tasks = blocks.mapPartitions(lambda part: [part_sums(part, *asked)])
    return tasks.treeReduce(np.add) if blocks.getNumPartitions() > FEW_TASKS else tasks.reduce(np.add)


def grow(width: int, number: int, s: Settings, sums: Callable[..., np.ndarray]) -> Tree:
    """One tree, level by level; ``sums`` gives those of the whole table for (tree, level, number, chosen inputs, open nodes, settings)."""
    chosen = drawn_inputs(width, number, s)
    tree, open_nodes = Tree.empty(s.depth), [0]
    known = sums(tree, 0, number, chosen, open_nodes, s)
    for level in range(s.depth):
        g, h = known
        split, cut, gain = best_splits(g, h, s)
        if level == 0:
            tree.values[0] = leaf(g[0, 0].sum(), h[0, 0].sum(), s)
        following, lesser = [], []  # open children: their parent's place, the place of the sibling with less weight, whether they are that one
        for k, node in enumerate(open_nodes):
            if not gain[k]:
                continue
            tree.inputs[node], tree.cuts[node], tree.gains[node] = chosen[split[k]], cut[k], gain[k]
            weight = []
            for child, part in ((2 * node + 1, slice(None, cut[k] + 1)), (2 * node + 2, slice(cut[k] + 1, None))):
                child_g, child_h = g[k, split[k], part].sum(), h[k, split[k], part].sum()
                tree.values[child] = leaf(child_g, child_h, s)
                weight.append(child_h)
            less = int(weight[1] < weight[0])
            wide = [side for side in (0, 1) if weight[side] >= 2 * s.child_weight]  # else no split leaves enough on both sides
            following += [(2 * node + 1 + side, k, len(lesser), side == less) for side in wide]
            lesser += [2 * node + 1 + less] if wide else []
        if not following or level + 1 == s.depth:
            break
        # a node's rows are those of its children, so only the lesser child's rows are read
        summed = sums(tree, level + 1, number, chosen, lesser, s)
        known = np.stack([summed[:, j] if own else known[:, k] - summed[:, j] for _, k, j, own in following], axis=1)
        open_nodes = [node for node, *_ in following]
    return tree


def tree_sums(kept: np.ndarray, g: np.ndarray, h: np.ndarray) -> Callable[..., np.ndarray]:
    """``sums`` for one tree of ``grow`` over all its rows: each level goes on from the nodes of the level before."""
    at, first, flat, columns = np.zeros(len(kept), np.int64), np.arange(len(kept)) * kept.shape[1], kept.ravel(), None

    def sums(tree: Tree, level: int, number: int, chosen: list[int], open_nodes: list[int], s: Settings) -> np.ndarray:
        nonlocal at, columns
        columns = np.ascontiguousarray(kept[:, chosen].T) if level == 0 else columns
        at = tree.step(at, first, flat) if level else at
        return node_sums(at, columns, g, h, open_nodes, s)

    return sums


def few_rows_trees(blocks: RDD, width: int, since: list[Tree], numbers: range, s: Settings) -> list[Tree]:
    """The next trees of rows that are one partition: its sums are those of the table, so a level needs no job."""
    def run(part: Iterator[tuple]) -> Iterator[Tree]:
        numbers_, label, margin, recent, bins = (np.concatenate(x) for x in zip(*[_unpacked(block, width) for block in part]))
        margin = margin + grown(recent, bins, since, s)
        for number in numbers:
            keep = np.flatnonzero(_drawn(numbers_, number, s))
            tree = grow(width, number, s, tree_sums(bins[keep], *derivatives(margin[keep], label[keep])))
            margin = grown(margin, bins, [tree], s)
            yield tree

    return blocks.mapPartitions(run).collect()


def _with_trees(block: tuple, width: int, since: list[Tree], s: Settings, to_store: bool = False) -> tuple:
    number, label, margin, recent, bins = _unpacked(block, width)
    recent = grown(recent, bins, since, s)
    return _packed(number, label, margin + recent, np.zeros(len(recent)), bins) if to_store else _packed(number, label, margin, recent, bins)


def best_splits(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input, cut and gain of each node's best split (gain 0: none); ``g``, ``h`` by node, input, bin."""
    left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    allowed = (left_h >= s.child_weight) & (right_h >= s.child_weight)
    gain = score(left_g, left_h, s) + score(right_g, right_h, s) - score(all_g, all_h, s)
    gain = np.where(allowed & (gain >= s.gamma) & (gain > 1e-6), gain, 0.0)
    flat = gain.reshape(len(g), -1)
    # sums come in any order, so gains that differ by rounding only are ties: the first one of them
    best = np.argmax(flat >= flat.max(axis=1, keepdims=True) * (1 - 1e-9), axis=1)
    return best // g.shape[2], best % g.shape[2], flat[np.arange(len(g)), best]


@dataclass
class Booster:
    """Trees, the cut points of the inputs, and the margin that all rows begin with."""

    inputs: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    settings: Settings

    def importance(self) -> dict[str, float]:
        """Mean gain of an input's splits, as a share of the sum of these."""
        total, n = np.zeros(len(self.inputs)), np.zeros(len(self.inputs))
        for tree in self.trees:
            split = tree.inputs >= 0
            np.add.at(total, tree.inputs[split], tree.gains[split])
            np.add.at(n, tree.inputs[split], 1)
        mean = total / np.maximum(n, 1)
        return dict(zip(self.inputs, (mean / (mean.sum() or 1.0)).tolist()))

    def score(self, df: DataFrame, out: str, keep: list[str] | None = None) -> DataFrame:
        """``df`` with the probability of a positive label; ``keep``: only these columns and the probability."""
        kept = [f for f in df.schema.fields if f.name != out] if keep is None else [df.schema[name] for name in keep]
        schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
        names = [f.name for f in kept]
        sent = df.select(*[f"`{name}`" for name in dict.fromkeys([*names, *self.inputs])])
        inputs, edges, base, trees, s = self.inputs, self.edges, self.base, self.trees, self.settings

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filled = [tree.filled(s.depth) for tree in trees]
            for batch in batches:
                margin = base + filled_margins(_matrix(batch, inputs, edges), filled, s)
                yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in names], pa.array(1.0 / (1.0 + np.exp(-margin)))], names=schema.names)

        return sent.mapInArrow(run, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row a tree and one an input, as Parquet."""
        rows = [(k, t.inputs.tolist(), t.cuts.tolist(), t.values.tolist(), t.gains.tolist()) for k, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree INT, inputs ARRAY<INT>, cuts ARRAY<INT>, node_values ARRAY<DOUBLE>, gains ARRAY<DOUBLE>").coalesce(1).write.parquet(f"{path}/trees")
        kinds = [(k, name, edge.tolist(), self.base, repr(vars(self.settings))) for k, (name, edge) in enumerate(zip(self.inputs, self.edges))]
        spark.createDataFrame(kinds, "place INT, name STRING, edges ARRAY<DOUBLE>, base DOUBLE, settings STRING").coalesce(1).write.parquet(f"{path}/inputs")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Booster:
        import ast

        kinds = sorted(spark.read.parquet(f"{path}/inputs").collect())
        trees = [
            Tree(np.array(r.inputs, np.int32), np.array(r.cuts, np.int32), np.array(r.node_values), np.array(r.gains))
            for r in sorted(spark.read.parquet(f"{path}/trees").collect())
        ]
        return Booster([r.name for r in kinds], [np.array(r.edges) for r in kinds], kinds[0].base, trees, Settings(**ast.literal_eval(kinds[0].settings)))


def fit(df: DataFrame, inputs: list[str], label: str, s: Settings = Settings(), tasks: int | None = None) -> Booster:
    """Boosted trees over numeric inputs without nulls. ``tasks``: partitions of the stored rows (as they come if not given)."""
    if not 2 <= s.bins <= 256:
        raise ValueError("bin numbers are bytes")
    edges = bin_edges(df, inputs, s.bins)
    rate = df.agg(F.avg(F.col(label).cast("double")).alias("r")).first().r
    if rate is None or not 0 < rate < 1:
        raise ValueError("training needs positive and negative rows")
    base = float(np.log(rate / (1 - rate)))
    width = len(inputs)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _joined(_binned_rows(batches, inputs, edges), BLOCK_ROWS):
            for k in range(0, len(rows[0]), BLOCK_ROWS):
                number, label, bins = (x[k : k + BLOCK_ROWS] for x in rows)
                block = _packed(number, label, np.full(len(label), base), np.zeros(len(label)), bins)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block], names=_BLOCK.names)

    spark = df.sparkSession
    numbered = df if tasks is None else df.repartition(tasks)
    # numbers are drawn from once they are stored
    plain = numbered.select(F.monotonically_increasing_id().alias("number"), F.col(label).cast("double").alias("label"), *[F.col(f"`{c}`").cast("double").alias(c) for c in inputs])
    stored = materialize(plain.mapInArrow(binned, _BLOCK), "binned-rows")
    n_blocks, n_rows = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("label") / 8), F.lit(0))).first()
    alone = n_rows <= FEW_ROWS
    parallel = 1 if alone else min(n_blocks, max(spark.sparkContext.defaultParallelism, int(n_rows // TASK_ROWS)))

    def cached(blocks: RDD) -> RDD:
        return blocks.persist(StorageLevel.MEMORY_AND_DISK)

    def from_store() -> RDD:
        return cached((stored.coalesce(1) if alone else stored.repartition(parallel)).rdd.map(tuple))

    def with_trees(since: list[Tree], to_store: bool = False) -> RDD:
        return blocks.map(lambda block: _with_trees(block, width, since, s, to_store))

    blocks = from_store()
    held = [blocks]  # cached since the last write: each is made of the one before
    trees: list[Tree] = []
    kept = 0  # trees in the blocks
    while len(trees) < s.trees:
        number = len(trees)
        if number and number % STORE_EVERY == 0:
            stored, kept = materialize(spark.createDataFrame(with_trees(trees[kept:], True), _BLOCK), "binned-rows"), number
            for old in held:
                old.unpersist()
            blocks = from_store()
            held = [blocks]
        elif number - kept == HOLD_EVERY and not alone:
            blocks, kept = cached(with_trees(trees[kept:])), number
            held.append(blocks)
        if alone:
            trees += few_rows_trees(blocks, width, trees[kept:], range(number, min(s.trees, number + STORE_EVERY - number % STORE_EVERY)), s)
            continue
        trees.append(grow(width, number, s, lambda *asked: level_sums(blocks, width, trees[kept:], *asked)))
        for old in held[:-1]:  # the newest is made by now
            old.unpersist()
        held = held[-1:]
    for old in held:
        old.unpersist()
    return Booster(list(inputs), edges, base, trees, s)


def leaf(g: float, h: float, s: Settings) -> float:
    return float(-shrink(g, s.l1) / (h + s.l2))
