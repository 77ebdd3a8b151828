"""Vector bin packing of examples into training sequences.

A sequence has three limits at once: tokens, segments (pieces of examples) and loss-bearing tokens. An example is a row of ids, of which those from
a given place on bear loss. Sequences are filled one at a time by the dot-product heuristic: of the pieces that fit, the one goes in whose
needs, as shares of the limits, have the largest dot product with what the sequence has left, so a sequence short of one resource takes pieces that
need little of it. When none fits, the piece with the largest product is cut so that its beginning fills the sequence, and the rest goes back to
the others. A sequence that runs into another limit before it is full, and the last ones of a task, are cut down to a power of two of tokens. So
no sequence needs padding: each has ``tokens`` ids or a power of two of them (``padding``).

A task packs the rows of its own partition: no shuffle, and no task sees more than its rows. It holds about ``POOL`` pieces
of less than one sequence each; examples of any length are cut into whole sequences as they arrive. Sequence numbers begin at a place of their own for each
partition, and a task that runs again, on the same rows in the same order, packs them alike.

Null texts are empty; every example has its end id, so an empty one is a piece of one id. Rows with null or equal ids, and repeated rows, are
examples of their own. Ties go to the type of piece that came first, then to its latest piece. Other columns are ignored. An empty
table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stampcard.llm.common import list_array, text_slices
from stampcard.llm.records import _encoder as library

#: Pieces that a task holds while it packs, and texts encoded at once.
POOL = 4096
_SLICE_BYTES = 8 << 20
#: Sequences of one partition: their numbers share the upper bits.
_PARTITION_BITS = 33


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


@dataclass
class Piece:
    """``ids[start:stop]`` of an example; ids from ``loss_from`` on bear loss."""

    example: int
    ids: np.ndarray
    start: int
    stop: int
    loss_from: int

    @property
    def size(self) -> int:
        return self.stop - self.start

    @property
    def loss(self) -> int:
        return max(0, self.stop - max(self.start, self.loss_from))

    def cut(self, size: int) -> tuple[Piece, Piece]:
        """The first ``size`` ids and the others."""
        at = self.start + size
        return Piece(self.example, self.ids, self.start, at, self.loss_from), Piece(self.example, self.ids, at, self.stop, self.loss_from)

    def most(self, tokens: int, loss: int) -> int:
        """How many ids from the start on stay within both limits."""
        free = max(0, min(self.stop, self.loss_from) - self.start)  # ids before the first one with loss
        return min(self.size, tokens, free + loss)


def padding(tokens: int, limits: Limits = Limits()) -> int:
    """Ids of padding that a sequence of this size needs: none at a power of two."""
    return 0 if tokens & (tokens - 1) == 0 else limits.tokens - tokens


class Pool:
    """Pieces by type (tokens, loss). Types are rows of an array; those without pieces are dropped when most are."""

    def __init__(self, limits: Limits):
        self.limits, self.size = limits, 0
        self._clear()

    def _clear(self) -> None:
        self.places: dict[tuple[int, int], int] = {}
        self.stacks: list[list[Piece]] = []
        self.types = np.zeros((2, 64), np.int64)
        self.counts = np.zeros(64, np.int64)

    def put(self, piece: Piece) -> None:
        key = piece.size, piece.loss
        at = self.places.get(key)
        if at is None:
            at = self.places[key] = len(self.stacks)
            self.stacks.append([])
            if at == len(self.counts):
                self.types, self.counts = np.concatenate([self.types] * 2, axis=1), np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.types[:, at], self.counts[at] = key, 0
        self.stacks[at].append(piece)
        self.counts[at] += 1
        self.size += 1

    def take(self, tokens: int, segments: int, loss: int) -> Piece | None:
        """The piece that suits best what is left: one that fits, or else one whose beginning does. None if there is none, or no segment is left."""
        if not self.size or not segments:
            return None
        n, limits = len(self.stacks), self.limits
        size, lost = self.types[0, :n], self.types[1, :n]
        held = self.counts[:n] > 0
        among = held & (size <= tokens) & (lost <= loss)
        if not among.any():
            among = held & (size - lost + loss > 0)  # ids with loss come last in a piece
            if not among.any():
                return None
        # every piece is one segment, so that the third term is the same for all
        product = size * (tokens / limits.tokens**2) + lost * (loss / limits.loss**2)
        at = int(np.argmax(np.where(among, product, -1.0)))
        piece = self.stacks[at].pop()
        self.counts[at] -= 1
        self.size -= 1
        if n > 256 and n > 4 * self.size:
            kept = [p for stack in self.stacks for p in stack]
            self._clear()
            self.size = 0
            for p in kept:
                self.put(p)
        return piece


class Packer:
    """Sequences of pieces, as they are ready."""

    def __init__(self, limits: Limits = Limits(), pool: int = POOL):
        if min(limits.tokens, limits.segments, limits.loss) < 1 or limits.tokens & (limits.tokens - 1):
            raise ValueError("limits are at least one, and the tokens of a sequence a power of two")
        self.limits, self.most, self.pool = limits, pool, Pool(limits)

    def add(self, example: int, ids: np.ndarray, loss_from: int = 0) -> Iterator[list[Piece]]:
        """One more example, of one id at least; whole sequences come from it at once."""
        rest = Piece(example, ids, 0, len(ids), loss_from)
        while rest.size >= self.limits.tokens and rest.most(self.limits.tokens, self.limits.loss) == self.limits.tokens:
            whole, rest = rest.cut(self.limits.tokens)
            yield [whole]
        while rest.size:
            size = rest.most(self.limits.tokens, self.limits.loss)
            piece, rest = rest.cut(size)
            self.pool.put(piece)
        if self.pool.size >= self.most:
            while self.pool.size > self.most // 2:
                yield self.fill()

    def finish(self) -> Iterator[list[Piece]]:
        while self.pool.size:
            yield self.fill()

    def fill(self) -> list[Piece]:
        """One sequence from the pool."""
        limits = self.limits
        tokens, segments, loss = limits.tokens, limits.segments, limits.loss
        out: list[Piece] = []
        while tokens and segments:
            piece = self.pool.take(tokens, segments, loss)
            if piece is None:
                break
            size = piece.most(tokens, loss)
            if size < piece.size:
                piece, rest = piece.cut(size)
                self.pool.put(rest)
            out.append(piece)
            tokens, segments, loss = tokens - size, segments - 1, loss - piece.loss
        used = limits.tokens - tokens
        over = used - (1 << used.bit_length() - 1)
        while over:  # down to a power of two, from the last piece back
            piece = out.pop()
            if piece.size > over:
                piece, rest = piece.cut(piece.size - over)
                out.append(piece)
                self.pool.put(rest)
                break
            over -= piece.size
            self.pool.put(piece)
        return out


_PIECE = [
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("example_tokens", T.LongType()), T.StructField("loss_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
]


class _Out:
    """Pieces as Arrow batches; held ids of an example go when its last piece is out."""

    def __init__(self, schema: T.StructType, id_type: pa.DataType, packed: bool):
        self.schema, self.id_type, self.packed = schema, id_type, packed
        self.rows, self.ids, self.held = [], [], 0

    def add(self, sequence: int, pieces: list[Piece], names: dict) -> None:
        at = 0
        for p in pieces:
            self.rows.append((names[p.example][0], p.start, p.size, len(p.ids), p.loss, sequence, at))
            self.ids.append(p.ids[p.start : p.stop])
            at += p.size
            left = names[p.example]
            left[1] -= p.size
            if not left[1]:
                del names[p.example]
        self.held += at

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows))
        if self.packed:
            ids = pa.array([i.astype("<u4").tobytes() for i in self.ids], pa.binary())
        else:
            ids = list_array(np.concatenate(self.ids), np.fromiter(map(len, self.ids), np.int64, len(self.ids)), pa.int32())
        arrays = [pa.array(list(columns[0]), self.id_type), *(pa.array(c, pa.int64()) for c in columns[1:]), ids]
        self.rows, self.ids, self.held = [], [], 0
        return pa.RecordBatch.from_arrays(arrays, names=self.schema.names)


def pack(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, limits: Limits = Limits(),
         packed: bool = False) -> DataFrame:
    """Pieces ``id_col, start, length, example_tokens, loss_tokens, sequence_id, offset, ids`` of all rows.

    The ids of an example are those of its prompt (``prompt_col``, which bears no loss), those of its text, and ``end_id``.
    ``tokenizer``: a file of the tokenizers library that every executor reaches; ``packed``: the ids as little-endian unsigned 32-bit numbers in one binary value."""
    ids_type = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *_PIECE, T.StructField("ids", ids_type)])
    columns = [id_col, text_col] + ([prompt_col] if prompt_col else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = library(tokenizer), Packer(limits)
        sequence, example = TaskContext.get().partitionId() << _PARTITION_BITS, 0
        names: dict[int, list] = {}  # id of each example that is not out yet, and ids that it still has in the pool
        out = None
        for part in text_slices(batches, text_col, _SLICE_BYTES):
            out = out or _Out(schema, part.column(0).type, packed)
            flat, counts = encoder.cache.ids(part.column(1))
            ends = np.cumsum(counts)
            before = None
            if prompt_col:
                before, sizes = encoder.cache.ids(part.column(2))
                prompt_ends = np.cumsum(sizes)
            for k, (name, b, n) in enumerate(zip(part.column(0).to_pylist(), ends.tolist(), counts.tolist())):
                own = [flat[b - n : b], [end_id]]
                if before is not None:
                    own.insert(0, before[prompt_ends[k] - sizes[k] : prompt_ends[k]])
                ids = np.concatenate(own).astype(np.int32)
                names[example] = [name, len(ids)]
                for pieces in packer.add(example, ids, int(sizes[k]) if before is not None else 0):
                    out.add(sequence, pieces, names)
                    sequence += 1
                example += 1
                if out.held > 1 << 20:
                    yield out.batch()
        for pieces in packer.finish():
            out.add(sequence, pieces, names)
            sequence += 1
            if out.held > 1 << 20:
                yield out.batch()
        if out is not None and out.rows:
            yield out.batch()

    return df.select(*columns).mapInArrow(run, schema)
