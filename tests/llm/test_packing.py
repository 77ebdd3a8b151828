"""Packing against the tokenizers library, its limits, and how full sequences are."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stampcard.llm import packing
from stampcard.llm.common import table
from stampcard.llm.queries import QUERIES
from tests.conftest import SF_SMALL

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def plain_ids(text, end=1):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end]


def check_sequences(pieces, limits):
    """``pieces``: (sequence, offset, length, loss). Offsets have no gap, all limits hold, nothing is padded."""
    by_sequence = {}
    for sequence, offset, length, loss in pieces:
        by_sequence.setdefault(sequence, []).append((offset, length, loss))
    for rows in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(rows):
            assert offset == at and length > 0
            at += length
        assert at <= limits.tokens and packing.padding(at, limits) == 0
        assert len(rows) <= limits.segments and sum(x[2] for x in rows) <= limits.loss
    return by_sequence


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 4, 64), packing.Limits(64, 64, 20), packing.Limits(128, 3, 50)])
@pytest.mark.parametrize("kind", ["mixed", "tiny", "long prompts", "no loss"])
def test_every_id_is_in_one_piece(limits, kind):
    rng = random.Random(len(kind) + limits.loss)
    examples = {}
    for k in range(600):
        n = 1 if kind == "tiny" else rng.choice([1, 2, 5, 30, 60, 64, 65, 200, 1000])
        prompt = {"mixed": rng.randint(0, n), "tiny": 0, "long prompts": n - 1, "no loss": n}[kind]
        examples[k] = np.arange(n, dtype=np.int32) + k, prompt
    packer = packing.Packer(limits, pool=64)
    sequences = [s for k, (ids, p) in examples.items() for s in packer.add(k, ids, p)] + list(packer.finish())
    covered = {k: np.zeros(len(ids), int) for k, (ids, _) in examples.items()}
    pieces = []
    for number, sequence in enumerate(sequences):
        at = 0
        for p in sequence:
            covered[p.example][p.start : p.stop] += 1
            loss = sum(i >= examples[p.example][1] for i in range(p.start, p.stop))
            assert loss == p.loss
            pieces.append((number, at, p.size, loss))
            at += p.size
    assert all((c == 1).all() for c in covered.values())
    check_sequences(pieces, limits)


def test_the_heuristic_weighs_what_is_left():
    """With loss nearly used up, a piece with little loss wins over one that needs it."""
    limits = packing.Limits(64, 8, 32)
    pool = packing.Pool(limits)
    heavy, light = packing.Piece(0, np.zeros(20, np.int32), 0, 20, 0), packing.Piece(1, np.zeros(22, np.int32), 0, 22, 20)
    pool.put(heavy)
    pool.put(light)
    assert pool.take(64, 8, 32) is heavy  # much loss left: the products are 20/64 + 20/32 and 22/64 + 2/32
    pool.put(heavy)
    assert pool.take(64, 8, 2) is light


def test_query(spark):
    docs = {r.doc_id: plain_ids(r.text) for r in table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()}
    rows = QUERIES["op12_vector_packing"](spark, SF_SMALL).collect()
    parts = {}
    for r in rows:
        ids = docs[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(docs[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        parts.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {d: sum(n for _, n in p) for d, p in parts.items()} == {d: len(i) for d, i in docs.items()}
    assert all(a + n == b for p in parts.values() for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:]))
    sequences = check_sequences([(r.sequence_id, r.offset, r.length, r.length) for r in rows], packing.Limits())
    whole = sum(sum(n for _, n, _ in s) == 2048 for s in sequences.values())
    assert whole == sum(map(len, docs.values())) // 2048 or len(sequences) - whole < 12 * 8


def test_odd_rows(spark, docs, odd_rows):
    frame = docs(odd_rows).withColumn("ids", F.lit("x")).withColumn("offset", F.lit(0))
    rows = packing.pack(frame, PATH, end_id=1).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        got.setdefault((r.doc_id, r.example_tokens), []).append((r.start, list(r.ids)))
    wanted = {}
    for i, t in odd_rows:
        ids = plain_ids(t)
        wanted.setdefault((i, len(ids)), []).append(ids)
    assert set(got) == set(wanted)
    for key, texts in wanted.items():
        assert sorted(i for _, ids in got[key] for i in ids) == sorted(i for ids in texts for i in ids)
    check_sequences([(r.sequence_id, r.offset, r.length, r.loss_tokens) for r in rows], packing.Limits())
    assert packing.pack(frame.limit(0), PATH, end_id=1).collect() == []


def test_prompts_bear_no_loss(spark):
    rows = [(k, "What is it? " * (k % 5), "It is this. " * (k % 7)) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    limits = packing.Limits(256, 16, 96)
    got = packing.pack(frame, PATH, end_id=1, prompt_col="prompt", limits=limits).collect()
    check_sequences([(r.sequence_id, r.offset, r.length, r.loss_tokens) for r in got], limits)
    loss = {}
    for r in got:
        loss[r.doc_id] = loss.get(r.doc_id, 0) + r.loss_tokens
    assert loss == {k: len(plain_ids(t)) for k, _, t in rows}
