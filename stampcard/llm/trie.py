"""Conversation prefix trie: every distinct beginning of a conversation, who shares it, and what sharing saves.

A turn's id is the first 16 bytes of the SHA-256 of its role and text; a conversation's key is the row of its turns' ids, big-endian, so keys
sort as sequences of turns. Keys are sorted by ranges over all tasks and cut into blocks of bounded size. Each block grows an adaptive
radix tree over the bytes of its keys: nodes change between layouts for 4, 16, 48 and 256 children, runs of single children are kept as one compressed path,
and only byte depths that are a multiple of the id width are nodes of the trie.

Nothing needs the whole trie in one place. A block knows the last key before it and the first key behind it. A node is open if one of
these begins with it, as no other block can hold it otherwise; all others are complete and final. What a block counts is made so that
it adds up: words of a node that an earlier block has are not counted again, nor is it a new child of its parent; an end is a leaf only where no
key behind goes on from it. So an open node is the sum over the blocks that hold it, by its digest. A node that a third of all
conversations share is one partial row for each block. The ids that end in an open node come as one text a block, and their digest
streams over these in order.

Conversations are ordered by turn (nulls first), then role, then id of the turn. Null roles and texts are empty; repeated rows are repeated turns;
texts of any length are digested and not carried. Rows without a conversation id belong to no conversation and are left out. Equal
conversations are members of the same nodes. A conversation's ids (16 bytes a turn) must fit a row. Other columns are ignored. An empty table has no trie,
not even a root.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stampcard.session import materialize

WIDTH = 16
#: Most keys and bytes of keys in a block (a longer key is a block of its own), and keys wanted in a task.
BLOCK_KEYS, BLOCK_BYTES, TASK_KEYS = 8192, 4 << 20, 200_000
WORD = r"[^\x20\x09-\x0D]+"


# The adaptive radix tree. A node is its compressed path, the rows (of the sorted block) below it, and the rows that end in it.


class Few:
    """Up to 4 or 16 children: sorted bytes beside the children."""

    __slots__ = ("bytes", "nodes", "most")

    def __init__(self, most: int = 4):
        self.bytes, self.nodes, self.most = bytearray(), [], most

    def find(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node):
        """The layout that holds the new child: this one, or a larger one."""
        if len(self.nodes) == self.most:
            larger = Few(16) if self.most == 4 else Indexed()
            for b, n in zip(self.bytes, self.nodes):
                larger = larger.put(b, n)
            return larger.put(byte, node)
        at = bisect_left(self.bytes, byte)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def children(self) -> list:
        return self.nodes


class Indexed:
    """Up to 48 children: one byte for each of 256 values says where the child is (0: nowhere)."""

    __slots__ = ("places", "nodes")

    def __init__(self):
        self.places, self.nodes = bytearray(256), []

    def find(self, byte: int):
        at = self.places[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node):
        if len(self.nodes) == 48:
            larger = Direct()
            for b, at in enumerate(self.places):
                if at:
                    larger.put(b, self.nodes[at - 1])
            return larger.put(byte, node)
        self.nodes.append(node)
        self.places[byte] = len(self.nodes)
        return self

    def children(self) -> list:
        return [self.nodes[at - 1] for at in self.places if at]


class Direct:
    """A child for each byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def find(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def children(self) -> list:
        return [n for n in self.nodes if n is not None]


class Node:
    """``key[start:end]`` is the path that leads into the node and through it; ``row`` is the first row below."""

    __slots__ = ("key", "start", "end", "row", "ends", "layout")

    def __init__(self, key: bytes, start: int, end: int, row: int):
        self.key, self.start, self.end, self.row = key, start, end, row
        self.ends: list[int] = []
        self.layout = None


def _shared(a: bytes, b: bytes, low: int, high: int) -> int:
    """Where ``a`` and ``b`` part between two depths, by halving; they agree up to ``low``."""
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    """Rows by key. The root stands for the empty key and has no path."""

    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, row: int) -> None:
        node = self.root
        if node is None:
            node = self.root = Node(b"", 0, 0, row)
        node.row = min(node.row, row)
        while True:
            if len(key) == node.end:
                node.ends.append(row)
                return
            byte = key[node.end]
            child = node.layout.find(byte) if node.layout else None
            if child is None:
                leaf = Node(key, node.end, len(key), row)
                leaf.ends.append(row)
                node.layout = (node.layout or Few()).put(byte, leaf)
                return
            stop = min(child.end, len(key))
            parts = _shared(child.key, key, child.start, stop)
            if parts < child.end:  # the path splits: its upper part becomes a node of its own, in the child's place
                lower = Node(child.key, parts, child.end, child.row)
                lower.ends, lower.layout = child.ends, child.layout
                child.end, child.ends, child.layout = parts, [], Few().put(child.key[parts], lower)
            child.row = min(child.row, row)
            node = child


class TurnNode:
    """A node of the trie as far as a block knows it."""

    __slots__ = ("row", "size", "depth", "before", "behind", "parent", "children", "leaves", "saved", "ends")

    def __init__(self, row: int, size: int, depth: int, before: bool, behind: bool, ends: list[int]):
        self.row, self.size, self.depth, self.before, self.behind, self.ends = row, size, depth, before, behind, ends
        self.parent, self.children, self.leaves, self.saved = None, 0, 0, 0

    @property
    def open(self) -> bool:
        return self.before or self.behind


def turn_nodes(keys: list[bytes], words: list[list[int]], last: bytes | None, following: bytes | None, width: int = WIDTH) -> list[TurnNode]:
    """Nodes of the trie over sorted keys, each after its subtree. ``last``, ``following``: the key before the first and behind the last one."""
    tree = RadixTree()
    for row, key in enumerate(keys):
        tree.insert(key, row)
    if tree.root is None:
        return []
    begins = -1 if last is None else _shared(last, keys[0], 0, min(len(last), len(keys[0])))
    goes_on = -1 if following is None else _shared(following, keys[-1], 0, min(len(following), len(keys[-1])))
    out: list[TurnNode] = []

    def emit(node: Node, size: int, below: list[TurnNode]) -> list[TurnNode]:
        """The trie nodes along the path of a tree node, from the lowest up; returns those that still lack a parent."""
        top = node.start // width if node.start or node.end else -1
        for depth in range(node.end // width, top, -1):
            at = depth * width
            before = node.row == 0 and at <= begins
            behind = node.row + size == len(keys) and at <= goes_on
            new = TurnNode(node.row, size, depth, before, behind, node.ends if at == node.end else [])
            new.saved = (size - (not before)) * words[node.row][depth - 1] if depth else 0
            for child in below:
                child.parent = new
                new.children += not child.before
                new.leaves += child.leaves
                new.saved += child.saved
            if not below and not behind:
                new.leaves = 1
            out.append(new)
            below = [new]
        return below

    # children first, without recursion: each entry is a node, its children still to do, and what those have given
    stack = [[tree.root, iter(tree.root.layout.children() if tree.root.layout else ()), len(tree.root.ends), []]]
    while True:
        entry = stack[-1]
        child = next(entry[1], None)
        if child is not None:
            stack.append([child, iter(child.layout.children() if child.layout else ()), len(child.ends), []])
            continue
        stack.pop()
        below = emit(entry[0], entry[2], entry[3])
        if not stack:
            return out
        stack[-1][2] += entry[2]
        stack[-1][3] += below


# The same over tables.


def turn_id(role, text):
    """16 bytes that stand for a turn: nulls are empty, and the role's length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.substring(digest, 1, 2 * WIDTH)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, as id (hex) and number of words of the text."""
    rows = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), turn_id(F.col("role"), F.col("text")).alias("id"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("words"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "id", "words")))  # nulls come first
    return rows.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["id"], t["words"])).alias("turns"))


_BLOCK = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("keys", T.ArrayType(T.BinaryType())),
    T.StructField("convs", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.ArrayType(T.IntegerType()))),
])
_NODE = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("node", T.BinaryType()), T.StructField("parent", T.BinaryType()),
    *[T.StructField(c, T.LongType()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
    T.StructField("ends", T.StringType()), T.StructField("ends_sha256", T.StringType()),
])
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
_NOTHING = hashlib.sha256().hexdigest()


def blocks(convs: DataFrame) -> DataFrame:
    """Rows ``part, block, keys, convs, words``: all conversations sorted by key, then id, cut into blocks; parts and blocks are in order."""
    keyed = convs.select(
        F.unhex(F.array_join(F.col("turns.id"), "")).alias("key"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turns.words").alias("words")
    )
    tasks = max(int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-convs.count() // TASK_KEYS))
    dealt = keyed.repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        types = [pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]

        def ready() -> pa.RecordBatch:
            columns = [[part], [number], *([list(c)] for c in zip(*held))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_BLOCK.names)

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                for row in zip(*(c.to_pylist() for c in batch.slice(a, 1024).columns)):
                    if held and (len(held) == BLOCK_KEYS or size + len(row[0]) > BLOCK_BYTES):
                        yield ready()
                        number, held, size = number + 1, [], 0
                    held.append(row)
                    size += len(row[0])
        if held:
            yield ready()

    return dealt.mapInArrow(cut, _BLOCK)


def with_neighbours(stored: DataFrame) -> DataFrame:
    """``stored`` blocks with the key before and the key behind each (null at the ends)."""
    edges = stored.select("part", "block", F.col("keys")[0].alias("first"), F.element_at("keys", -1).alias("last"))
    parts = edges.groupBy("part").agg(F.min_by("first", "block").alias("first"), F.max_by("last", "block").alias("last"))
    in_order = Window.orderBy("part")  # one row a task of the sort: as long as the list of tasks
    parts = parts.select("part", F.lag("last").over(in_order).alias("part_before"), F.lead("first").over(in_order).alias("part_behind"))
    inside = Window.partitionBy("part").orderBy("block")
    edges = edges.select("part", "block", F.lag("last").over(inside).alias("b"), F.lead("first").over(inside).alias("f")).join(parts, "part")
    beside = edges.select("part", "block", F.coalesce("b", "part_before").alias("before"), F.coalesce("f", "part_behind").alias("behind"))
    return stored.join(beside, ["part", "block"])


def block_nodes(neighboured: DataFrame) -> DataFrame:
    """Nodes of each block; open ones with the digest of their path (``node``) and the ids that end there (``ends``)."""
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.string()]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1).to_pylist()[0]
                keys, convs = x["keys"], x["convs"]
                lows = _lows(convs)
                nodes = turn_nodes(keys, x["words"], x["before"], x["behind"])
                names = _paths(nodes, keys)
                rows = []
                for n in nodes:
                    low = lows(n.row, n.size)
                    up = n.parent
                    parent = None if up is None or up.open else lows(up.row, up.size)
                    ends = ",".join(str(convs[r]) for r in n.ends)
                    digest = None if n.open else hashlib.sha256(ends.encode()).hexdigest() if ends else _NOTHING
                    rows.append((
                        x["part"], x["block"], names.get(id(n)), names.get(id(up)) if up is not None and up.open else None, low, n.depth, parent, n.size, n.children,
                        n.leaves, n.saved, ends if n.open and ends else None, digest,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=_NODE.names)

    return neighboured.select("part", "block", "keys", "convs", "words", "before", "behind").mapInArrow(grow, _NODE)


def _lows(convs: list[int]):
    """A function for the least of a stretch of rows, by minima over stretches of powers of two."""
    levels = [convs]
    while 2 << len(levels) - 1 <= len(convs):
        half, below = 1 << len(levels) - 1, levels[-1]
        levels.append([min(a, b) for a, b in zip(below, below[half:])])

    def low(row: int, size: int) -> int:
        k = size.bit_length() - 1
        return min(levels[k][row], levels[k][row + size - (1 << k)])

    return low


def _paths(nodes: list[TurnNode], keys: list[bytes]) -> dict[int, bytes]:
    """Digests of the paths of open nodes, by object; these lie on the paths of the first and the last key."""
    out = {}
    wanted: dict[int, list[TurnNode]] = {}
    for n in nodes:
        if n.open:
            wanted.setdefault(n.row, []).append(n)
    for row, some in wanted.items():
        digest, done = hashlib.sha256(), 0
        for n in sorted(some, key=lambda n: n.depth):
            digest.update(keys[row][done : n.depth * WIDTH])
            done = n.depth * WIDTH
            out[id(n)] = digest.digest()
    return out


def _end_digests(open_nodes: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of open nodes in which conversations end: the texts of the blocks, in order, joined by commas."""
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("found", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for node, ends in zip(batch.column("node"), batch.column("ends")):
                if node.as_py() != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = node.as_py(), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ends.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=schema.names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], names=schema.names)

    texts = open_nodes.where("ends IS NOT NULL").select("node", "part", "block", "ends")
    dealt = texts.repartition("node").sortWithinPartitions("node", "part", "block").select("node", "ends")
    return dealt.mapInArrow(run, schema)


def prefix_trie(convs: DataFrame) -> DataFrame:
    """Nodes ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of all beginnings of conversations.

    ``convs``: ``conv_id, turns`` as from ``sequences``."""
    stored = materialize(blocks(materialize(convs, "trie-conversations")), "trie-blocks")
    nodes = materialize(block_nodes(with_neighbours(stored)), "trie-nodes")
    open_nodes = nodes.where("node IS NOT NULL")
    sums = open_nodes.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent").alias("parent"), *[F.sum(c).alias(c) for c in _SUMS]
    )
    whole = materialize(sums.join(_end_digests(open_nodes), "node", "left"), "trie-open-nodes")
    low = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    upper = whole.join(low, "parent", "left").withColumn("ends_sha256", F.coalesce("found", F.lit(_NOTHING)))
    # complete nodes below an open one find it among the open nodes of their own block, so no node is asked for by all
    near = open_nodes.select("part", "block", F.col("node").alias("parent")).join(low, "parent").withColumnRenamed("parent_conv_id", "found_parent")
    lower = nodes.where("node IS NULL").join(near, ["part", "block", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", *_SUMS, "ends_sha256"]
    return upper.select(*columns).union(lower.select(*columns))


def rebuilt(convs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations that share beginnings: the first h turns of the conversation ``c - c % family``, then the own turns after the first h, where
    h is ``crc32(c) % most``."""
    own = convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % family).alias("head_id"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h"))
    heads = convs.select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most - 1).alias("head"))
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "head_id", "left").select("conv_id", F.concat(head, rest).alias("turns"))
