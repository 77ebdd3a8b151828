"""Files against the tokenizers library: ids, order, offsets, damage."""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers as P
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stampcard.llm import queries, records
from stampcard.llm.common import table
from tests.conftest import SF_SMALL

FILE = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)
LIBRARY.encode_special_tokens = True


def plain_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def test_all_documents(spark):
    docs = sorted(table(spark, SF_SMALL, "documents").select("doc_id", "text").collect())
    ids = [plain_ids(r.text) for r in docs]
    starts = [0, *accumulate(map(len, ids))]
    wanted = [(r.doc_id, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, s, i in zip(docs, starts, ids)]
    assert sorted(map(tuple, queries.QUERIES["op9_token_records"](spark, SF_SMALL).collect())) == wanted


def test_odd_rows_special_strings_and_shuffled_reads(docs, odd_rows, tmp_path):
    rows = [*odd_rows, (20, "a <|endoftext|> b")]
    folder = str(tmp_path / "r")
    index = records.write_records(docs(rows).withColumn("shard", F.lit("x")), folder, FILE, end_id=0, shards=4)
    found = records.read_records(index.orderBy(F.rand(1)), folder).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in found), key=key) == sorted(((i, plain_ids(t)) for i, t in rows), key=key)
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *accumulate(r.n_tokens for r in ordered)][:-1]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in ordered] == sorted((r.doc_id is not None, r.doc_id or 0) for r in ordered)
    assert records.read_records(index.where("doc_id = 20"), folder).first().ids == plain_ids("a <|endoftext|> b")


def test_damage_is_seen(tmp_path):
    path = str(tmp_path / "x.rec")
    data = bytearray(records.frame(b"abcd") + records.frame(b"wxyz"))
    open(path, "wb").write(data)
    with fs.LocalFileSystem().open_input_file(path) as file:
        assert records.read_frame(file, 20) == b"wxyz"
    for at in (21, 34, 38):
        worse = data.copy()
        worse[at] ^= 1
        open(path, "wb").write(worse)
        with fs.LocalFileSystem().open_input_file(path) as file, pytest.raises(ValueError):
            records.read_frame(file, 20)


def test_empty_table(docs, tmp_path):
    folder = str(tmp_path / "r")
    index = records.write_records(docs([]), folder, FILE, end_id=0)
    assert index.count() == 0 and records.read_records(index, folder).count() == 0
