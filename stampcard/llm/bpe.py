"""Byte-level BPE with a segment tree over byte positions.

The tree's leaves are positions of a piece; a leaf holds ``rank * capacity + position`` of the pair that begins there, so the root is
the leftmost pair of least rank. A merge changes three leaves (the pair itself, the pair before it, the position swallowed), each
in logarithmic time, and links the live neighbours anew. Many short pieces run side by side in numpy, one merge of each per step;
long pieces run one at a time.

``encode`` adds the ids of a text, ``decode`` the bytes of ids. Null texts count as empty (no ids); null ids give empty bytes;
repeated rows stay repeated; other columns pass through, except those named like the output, which are replaced.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stampcard.llm.chunks import ChunkCache
from stampcard.llm.common import add_columns, list_array, worker_state

_NONE = np.iinfo(np.int64).max
#: Pieces over this many bytes are encoded one by one; shorter ones side by side.
LONG_PIECE = 256
_SIDE_BY_SIDE = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """Rank of the token that two adjacent tokens form, for scalars and arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        order = sorted(self.pairs)
        self.keys = np.array([*order, _NONE], np.int64)
        self.values = np.array([*(self.pairs[k] for k in order), 0], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a value beyond all ranks; a token of -1 is none."""
        wanted = left * self.size + right
        at = np.searchsorted(self.keys, wanted)
        known = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.values[at], -1)


def merge_long(piece: bytes, merges: Merges) -> list[int]:
    """Ids of one piece: the tree as a list, updated leaf by leaf."""
    n, pairs, size = len(piece), merges.pairs, merges.size
    token = merges.byte_rank[np.frombuffer(piece, np.uint8)].tolist()
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    cap = 1 << max(1, (n - 1).bit_length())
    tree = [_NONE] * (2 * cap)
    for i in range(n - 1):
        rank = pairs.get(token[i] * size + token[i + 1])
        if rank is not None:
            tree[cap + i] = rank * cap + i
    for i in range(cap - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: int) -> None:
        i += cap
        tree[i] = value
        i >>= 1
        while i:
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    while tree[1] != _NONE:
        rank, i = divmod(tree[1], cap)
        gone = after[i]
        token[i], token[gone] = rank, -1
        after[i] = after[gone]
        put(gone, _NONE)
        if after[i] >= 0:
            before[after[i]] = i
            rank = pairs.get(token[i] * size + token[after[i]])
            put(i, _NONE if rank is None else rank * cap + i)
        else:
            put(i, _NONE)
        if before[i] >= 0:
            rank = pairs.get(token[before[i]] * size + token[i])
            put(before[i], _NONE if rank is None else rank * cap + before[i])
    return [t for t in token if t >= 0]


def merge_short(pieces: list[bytes], cap: int, merges: Merges) -> list[list[int]]:
    """Ids of pieces of up to ``cap`` bytes: one tree per row, one merge of each row per step."""
    k = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, k)
    raw = np.frombuffer(b"".join(p.ljust(cap, b"\0") for p in pieces), np.uint8).reshape(k, cap)
    column = np.arange(cap)
    token = np.where(column < sizes[:, None], merges.byte_rank[raw], -1)
    token = np.concatenate([token, np.full((k, 1), -1)], axis=1)  # the last column stands for "no neighbour"
    after = np.where(column + 1 < sizes[:, None], column + 1, cap)
    after = np.concatenate([after, np.full((k, 1), cap)], axis=1)
    before = np.tile(np.concatenate([[cap], np.arange(cap)]), (k, 1))
    before[:, cap] = cap
    ranks = merges.rank(token[:, :cap].ravel(), token[:, 1:].ravel()).reshape(k, cap)
    tree = np.full((k, 2 * cap), _NONE)
    tree[:, cap:] = np.where(ranks >= 0, ranks * cap + column, _NONE)
    width = cap
    while width > 1:
        tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
        width //= 2

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        at = at + cap
        tree[rows, at] = value
        while cap > 1 and at[0] > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        best = tree[rows, 1]
        i, rank = best % cap, best // cap
        gone = after[rows, i]
        following, preceding = after[rows, gone], before[rows, i]
        token[rows, i], token[rows, gone] = rank, -1
        after[rows, i], before[rows, following] = following, i
        put(rows, gone, np.full(len(rows), _NONE))
        ahead = merges.rank(rank, token[rows, following])
        put(rows, i, np.where(ahead >= 0, ahead * cap + i, _NONE))
        behind = merges.rank(token[rows, preceding], rank)
        has = preceding < cap
        put(rows[has], preceding[has], np.where(behind >= 0, behind * cap + preceding, _NONE)[has]) if has.any() else None
        rows = rows[tree[rows, 1] != _NONE]
    live = token[:, :cap] >= 0
    flat, ends = token[:, :cap][live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Ids of chunks: each match of the pattern alone, whole matches that are tokens first, as byte-level BPE libraries do."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.merges = Merges(ranks)
        self.pattern = regex.compile(pattern)
        self.cache = ChunkCache(self.encode_chunks)
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.table = np.full(self.merges.size + 1, 0, np.int64)
        lengths = np.zeros(self.merges.size, np.int64)
        for token, rank in order:
            lengths[rank] = len(token)
        self.table[1:] = np.cumsum(lengths)
        self.bytes = np.frombuffer(b"".join(t for t, _ in order), np.uint8)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.merges.ranks.get(piece)
            if whole is not None:
                out[k] = [whole]
            elif len(piece) > LONG_PIECE:
                out[k] = merge_long(piece, self.merges)
            else:
                classes.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(k)
        for cap, places in classes.items():
            step = max(1, _SIDE_BY_SIDE // cap)
            for a in range(0, len(places), step):
                part = places[a : a + step]
                for k, ids in zip(part, merge_short([pieces[k] for k in part], cap, self.merges)):
                    out[k] = ids
        return out

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        cut = [self.pattern.findall(c) for c in chunks]
        new = list({p for pieces in cut for p in pieces})
        known = dict(zip(new, self.encode_pieces([p.encode() for p in new])))
        return [known[p[0]] if len(p) == 1 else [i for x in p for i in known[x]] for p in cut]

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes of the ids, one value per count."""
        starts, sizes = self.table[flat], self.table[flat + 1] - self.table[flat]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.bytes[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).cast(pa.binary())


def _encoder(path: str, pattern: str) -> Encoder:
    return worker_state(("bpe", path, pattern), lambda: Encoder(path, pattern))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", bytes_col: str | None = None) -> DataFrame:
    """``df`` with the ids of the text (array of int) by the rank file at ``path``, which every executor must reach.

    With ``bytes_col`` the ids are also decoded in the same pass, for a check of the round trip."""
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField(bytes_col, T.BinaryType())] if bytes_col else []

    def make(texts: list[str]) -> list[pa.Array]:
        flat, counts = _encoder(path, pattern).cache.ids(texts)
        ids = list_array(flat, counts, pa.int32())
        return [ids, _encoder(path, pattern).decode(flat, counts)] if bytes_col else [ids]

    return add_columns(df, text_col, fields, make)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name.lower() != bytes_col.lower()], T.StructField(bytes_col, T.BinaryType())])
    kept = df.select(*[f"`{f.name}`" for f in schema.fields[:-1]])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids = part.column(ids_col)
                counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ids), 0)).astype(np.int64)
                flat = np.asarray(ids.flatten()).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, _encoder(path, pattern).decode(flat, counts)], names=schema.names)

    return kept.mapInArrow(run, schema)
