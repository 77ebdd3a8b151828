"""Token ids as length-delimited binary records, with a separate offset index.

A shard file is a row of records. A record is: payload length (unsigned 64-bit), its masked checksum, the payload, its masked checksum.
Numbers are little-endian; checksums are CRC-32, rotated right by 15 bits plus a constant, so that a checksum of data that holds
checksums stays telling. The payload is the ids of one document as 16-bit numbers, or 32-bit ones for larger vocabularies.

The index is a Parquet table with one row a record: id, shard, offset, number of tokens, and the number of tokens of all records before
it. Readers may take index rows in any order and seek; whole files need no index.

Documents are dealt to shards by ranges of the id, so the order of shards and records is that of the ids (null ids first, ties by a hash
of the text, repeated rows stay repeated). A task writes its shard under a name of its own and renames it when whole; a task that
runs again, for a lost executor, writes the same bytes. The index is committed after all shards, so a folder with an index is complete.
Files are opened through ``pyarrow.fs``, so the folder may be in any store that it and Spark both reach.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stampcard.llm.chunks import ChunkCache
from stampcard.llm.common import key_runs, list_array, text_slices, worker_state

_MASK = 0xA282EAD8
#: Texts encoded at once: the more, the fewer lookups for repeated words.
_SLICE_BYTES = 8 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(head).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def read_frame(file, offset: int) -> bytes:
    """Payload of the record at ``offset``; raises if a checksum or a length is wrong."""
    file.seek(offset)
    head = file.read(12)
    if len(head) < 12 or masked(head[:8]) != int.from_bytes(head[8:], "little"):
        raise ValueError(f"damaged length at {offset}")
    size = int.from_bytes(head[:8], "little")
    body = file.read(size + 4)
    if len(body) < size + 4 or masked(body[:size]) != int.from_bytes(body[size:], "little"):
        raise ValueError(f"damaged record at {offset}")
    return body[:size]


def shard_name(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.rec"


class LibraryEncoder:
    """Ids by a file of the tokenizers library; special strings inside texts are ordinary text.

    A task has a core of its own, so the library's threads, which cost more than they give on single words, stay off.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache = ChunkCache(lambda chunks: [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])


def _encoder(path: str) -> LibraryEncoder:
    return worker_state(("tokenizers", path), lambda: LibraryEncoder(path))


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None
) -> DataFrame:
    """Write the encoded texts below ``folder`` and return the index. ``tokenizer``: a byte-level file that every executor reaches;
    ``end_id`` closes each document; ``shards``: as many files as shuffle partitions if not given. Null texts are empty."""
    spark = docs.sparkSession
    order = [F.col(id_col), F.xxhash64(text_col)]
    picked = docs.select(F.col(id_col), F.col(text_col))
    dealt = (picked.repartitionByRange(shards, *order) if shards else picked.repartitionByRange(*order)).sortWithinPartitions(*order)
    found = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("shard", T.LongType()), T.StructField("offset", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("before", T.LongType()), T.StructField("width", T.IntegerType()),
    ])

    def write(batches):
        task = TaskContext.get()
        shard = task.partitionId()
        encoder = _encoder(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        own, offset, before = f"{root}/.writing-{shard}-{task.taskAttemptId()}", 0, 0
        with files.open_output_stream(own) as out:
            for part in text_slices(batches, text_col, _SLICE_BYTES):
                flat, counts = encoder.cache.ids(part.column(text_col))
                flat = flat.astype(f"<u{width}")
                ends = np.cumsum(counts).tolist()
                close = np.array([end_id], f"<u{width}").tobytes()
                records = [frame(flat[a:b].tobytes() + close) for a, b in zip([0, *ends], ends)]
                out.write(b"".join(records))
                sizes, tokens = np.fromiter(map(len, records), np.int64, len(records)), counts + 1
                yield pa.RecordBatch.from_arrays([
                    part.column(id_col), pa.array(np.full(part.num_rows, shard)), pa.array(offset + np.cumsum(sizes) - sizes), pa.array(tokens),
                    pa.array(before + np.cumsum(tokens) - tokens), pa.array(np.full(part.num_rows, width, np.int32)),
                ], names=found.names)
                offset, before = offset + int(sizes.sum()), before + int(tokens.sum())
        files.move(own, shard_name(root, shard))

    dealt.mapInArrow(write, found).write.parquet(f"{folder}/written")
    written = spark.read.schema(found).parquet(f"{folder}/written")
    totals = written.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    # one row a shard: the window is as large as the list of files
    bases = totals.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("base"))
    index = written.join(bases, "shard").select(F.col("id").alias(id_col), "shard", "offset", "n_tokens", (F.col("base") + F.col("before")).alias("start"), "width")
    index.write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, packed: bool = False) -> DataFrame:
    """Index rows with their ``ids``, read from the shard files and checked. Any subset or order of the index will do.
    ``packed``: the ids as little-endian unsigned 32-bit numbers in one binary value, instead of an array of longs."""
    kind = T.BinaryType() if packed else T.ArrayType(T.LongType(), False)
    schema = T.StructType([*[f for f in index.schema.fields if f.name.lower() != "ids"], T.StructField("ids", kind)])
    kept = index.select(*[f"`{f.name}`" for f in schema.fields[:-1]])

    def read(batches):
        files, root = fs.FileSystem.from_uri(folder)
        for run in key_runs(batches, "shard"):
            with files.open_input_file(shard_name(root, run["shard"][0].as_py())) as file:
                for a in range(0, run.num_rows, 256):
                    part = run.slice(a, 256).combine_chunks()
                    ids = [np.frombuffer(read_frame(file, o), f"<u{w}") for o, w in zip(part["offset"].to_pylist(), part["width"].to_pylist())]
                    if packed:
                        lists = pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())
                    else:
                        lists = list_array(np.concatenate(ids).astype(np.int64), np.fromiter(map(len, ids), np.int64, len(ids)), pa.int64())
                    yield pa.RecordBatch.from_arrays([*[c.chunk(0) for c in part.columns], lists], names=schema.names)

    return kept.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(read, schema)
