"""SimHash near-duplicates by vantage-point trees.

``fingerprints`` gives each text 64 bits. Two fingerprints are linked if at most ``radius`` bits differ. Equal fingerprints are
one node from the start, so groups of copies never meet pair by pair.

Links are found by vantage-point trees over Hamming distance. At a distance d over some of the bits no more than at all 64, a pair
within the radius is within ``radius // TREES`` in one of ``TREES`` disjoint blocks of bits: each block has its own tree with that
smaller radius, where the triangle bound prunes far more than over the whole word. The upper part of a tree is built on the driver
from a bounded sample of fingerprints (about ``SAMPLE`` rows); its leaves are shards. Every fingerprint has one home shard and visits
the later shards that its ball overlaps. A shard grows its own tree, prunes by the triangle bound, compares whole words exactly,
and returns a spanning forest of its links rather than all pairs. Which sample was drawn decides the balance, never the result.

Null or wordless texts have fingerprint zero and are linked like others. Repeated rows stay repeated. A component is named by its smallest
id; it is null if none of its rows has one. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stampcard.llm.common import add_columns, hashed_share, key_runs, row_key
from stampcard.llm.components import components, forest
from stampcard.session import materialize

RADIUS = 4
SHINGLE = 4
SEED = 42
TREES = 3
#: Fingerprints that the upper trees are grown from, the most shards of a tree, and fingerprints wanted in a shard.
SAMPLE, MOST_SHARDS, SHARD_ROWS = 32_768, 1024, 8192
_LEAF = 128


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    count = len(words) - size + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:count].tolist(), ends[size - 1 :].tolist())), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for a in range(0, count, 4096):
        bits = np.unpackbits(hashes[a : a + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", to_col: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint of the whole text as a (signed) long."""

    def make(texts: list[str]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

    return add_columns(df, text_col, [T.StructField(to_col, T.LongType())], make)


def block_masks(trees: int = TREES) -> list[int]:
    bounds = [64 * k // trees for k in range(trees + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]


def _distance(words: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(words ^ vantage)


def _split(words: np.ndarray) -> tuple[np.uint64, int] | None:
    """Vantage point and distance bound that part these words most evenly; None if none parts them."""
    best = None
    for vantage in words[:: max(1, len(words) // 8)][:8]:
        away = _distance(words, vantage)
        bound = int(np.median(away))
        for b in (bound - 1, bound):
            inside = int((away <= b).sum())
            if 0 < inside < len(words) and (best is None or abs(2 * inside - len(words)) < best[0]):
                best = (abs(2 * inside - len(words)), vantage, b)
    return best and best[1:]


def grow(words: np.ndarray, shards: int) -> list:
    """An upper tree as nested ``[vantage, bound, inside, outside]``; leaves are shard numbers in order."""
    leaves = iter(range(1 << 30))

    def node(part: np.ndarray, want: int):
        cut = _split(part) if want > 1 and len(part) > 1 else None
        if cut is None:
            return next(leaves)
        near = _distance(part, cut[0]) <= cut[1]
        share = max(1, min(want - 1, round(want * near.mean())))
        return [cut[0], cut[1], node(part[near], share), node(part[~near], want - share)]

    return node(words, shards)


def route(tree, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shard, and whether it is the row's home, for all shards that the ball of a word overlaps."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def walk(node, rows: np.ndarray, home: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, int):
            out.append((rows, np.full(len(rows), node), home))
            return
        vantage, bound, inside, outside = node
        away = _distance(words[rows], vantage).astype(np.int64)
        near, far = away <= bound + radius, away > bound - radius
        walk(inside, rows[near], (home & (away <= bound))[near])
        walk(outside, rows[far], (home & (away > bound))[far])

    walk(tree, np.arange(len(words)), np.ones(len(words), bool))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


class Links:
    """Links found so far, kept as a spanning forest once they are many."""

    def __init__(self, most: int = 1 << 20):
        self.left, self.right, self.held, self.most = [], [], 0, most

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self.left.append(left)
        self.right.append(right)
        self.held += len(left)
        if self.held > self.most:
            self.left, self.right = ([x] for x in forest(np.concatenate(self.left), np.concatenate(self.right)))
            self.held = len(self.left[0])
            self.most = max(self.most, 2 * self.held)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return forest(np.concatenate(self.left), np.concatenate(self.right))


def shard_links(points: np.ndarray, visitors: np.ndarray, mask: np.uint64, near: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links among ``points`` and from ``visitors`` to them."""
    found = Links()
    words = np.concatenate([points, visitors])
    part = words & mask

    def compare(own: np.ndarray, asking: np.ndarray) -> None:
        step = max(1, (1 << 20) // max(1, len(own)))
        for a in range(0, len(asking), step):
            q = asking[a : a + step]
            hit = np.bitwise_count(words[q][:, None] ^ words[own][None, :]) <= radius
            i, j = np.nonzero(hit)
            some = q[i] != own[j]
            found.add(words[q[i][some]].view(np.int64), words[own[j][some]].view(np.int64))

    def search(own: np.ndarray, asking: np.ndarray) -> None:
        if not len(own) or not len(asking):
            return
        cut = _split(part[own]) if len(own) > _LEAF else None
        if cut is None:
            for a in range(0, len(own), 1 << 14):
                compare(own[a : a + (1 << 14)], asking)
            return
        mine, theirs = _distance(part[own], cut[0]), _distance(part[asking], cut[0]).astype(np.int64)
        search(own[mine <= cut[1]], asking[theirs <= cut[1] + near])
        search(own[mine > cut[1]], asking[theirs > cut[1] - near])

    search(np.arange(len(points)), np.arange(len(words)))
    return found.edges()


def links(nodes: DataFrame, radius: int = RADIUS, trees: int = TREES) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp``, whose components are those of all pairs within ``radius`` bits."""
    total = nodes.count()
    shards = int(min(MOST_SHARDS, max(1, -(-total // SHARD_ROWS))))
    sample = np.array([r.fp for r in nodes.where(hashed_share("fp", SAMPLE, total)).select("fp").collect()], np.int64).view(np.uint64)
    masks, near = [np.uint64(m) for m in block_masks(trees)], radius // trees
    upper = [grow(sample & m, shards) for m in masks]
    routed = T.StructType([T.StructField("shard", T.LongType()), T.StructField("home", T.BooleanType()), T.StructField("fp", T.LongType())])
    edge = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def deal(batches):
        for batch in batches:
            words = np.asarray(batch.column("fp")).view(np.uint64)
            for k, (tree, mask) in enumerate(zip(upper, masks)):
                rows, shard, home = route(tree, words & mask, near)
                own = np.zeros(len(words), np.int64)
                own[rows[home]] = shard[home]
                used = home | (shard > own[rows])  # a pair in two shards meets in the later one
                yield pa.RecordBatch.from_arrays([pa.array(shard[used].astype(np.int64) + (k << 32)), pa.array(home[used]), pa.array(words[rows[used]].view(np.int64))], names=routed.names)

    def meet(batches):
        for run in key_runs(batches, "shard"):
            shard, home, words = run["shard"][0].as_py(), np.asarray(run["home"]), np.asarray(run["fp"]).view(np.uint64)
            left, right = shard_links(words[home], words[~home], masks[shard >> 32], near, radius)
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=edge.names)

    dealt = nodes.select("fp").mapInArrow(deal, routed)
    return dealt.repartition(trees * shards, "shard").sortWithinPartitions("shard").mapInArrow(meet, edge).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``id_col, fp, component_id`` of every row: the smallest id reachable over links."""
    printed = materialize(fingerprints(df.select(id_col, text_col), text_col, shingle=shingle).select(id_col, "fp"), "fingerprints")
    nodes = materialize(printed.groupBy("fp").agg(F.min(id_col).alias("low")), "fingerprint-nodes")
    roots = components(links(nodes, radius)).withColumnRenamed("node", "fp")
    linked = materialize(roots.join(nodes, "fp"), "fingerprint-roots")
    named = linked.select("fp", "root").join(linked.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", F.col("component_id").alias("named"))
    classes = nodes.join(named, "fp", "left").select("fp", F.coalesce("named", "low").alias("component_id"))
    return printed.join(classes, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group, unchanged: the smallest id (a null id last), then the smallest row key; of repeated rows one."""
    ordered = docs.select(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk")).alias("who"), F.col(text_col).alias("body"))
    groups = near_duplicates(ordered, "who", "body", radius, shingle)
    first = materialize(groups.where("who = component_id").select(F.col("who.rk").alias("__rk")).distinct(), "first-of-group")
    keyed = docs.withColumn("__rk", row_key(id_col, text_col)).join(first, "__rk", "left_semi")
    # the window asks for the partitioning and order that the join has where both sides are shuffled
    return keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__rk").orderBy("__rk"))).where("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
