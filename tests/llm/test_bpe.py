"""Ids against the tiktoken library, bytes against the texts."""

from __future__ import annotations

import random

import public_tokenizers as P
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from stampcard.llm import bpe, records
from stampcard.llm.chunks import GLUED, split_texts, split_words

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_random_strings_as_the_library():
    encoder, rng = bpe.Encoder(RANKS, P.PATTERN), random.Random(3)
    texts = ["".join(rng.choice("ab the  ñé漢🙂\n\t 12.,!'s\x1c \x85") for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["z" * 3000, "the" * 2000, " " * 500, "a b", "\n a", "é" * 400]
    flat, counts = encoder.cache.ids(texts)
    at = 0
    for text, n in zip(texts, counts):
        assert flat[at : at + n].tolist() == LIBRARY.encode_ordinary(text)
        at += n
        assert " ".join(split_words(text)) == GLUED + text


def test_cuts_of_single_texts_change_no_ids():
    """One text a call, so that those without odd white space are cut by Arrow; three tokenizers."""
    encoder, rng = bpe.Encoder(RANKS, P.PATTERN), random.Random(4)
    texts = ["".join(rng.choice(["ab", "The", " ", " ", "ñé", "漢", "🙂", "\n", "12", ".", ",", "!'", "'s", "?)", "µ", "\xaa", "ß", "Ǆ"]) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += ["a\nb.\nc d.'s e", "a \x01b\x01 \x01.", "\n", "a\n", "\na", "", "x.\r\ny", "end.\n\nNext"]
    cut = 0
    for text in texts:
        chunks, counts = split_texts(pa.array([text]))
        cut += len(chunks) > 1 and "".join(c[1:] if c[:1] == GLUED else " " + c for c in chunks.to_pylist()) == text
        assert encoder.cache.ids([text])[0].tolist() == LIBRARY.encode_ordinary(text)
    assert cut > 500
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = records.LibraryEncoder(P.path(name))
        for text in texts:
            assert library.cache.ids([text])[0].tolist() == library.tokenizer.encode(text, add_special_tokens=False).ids


def test_both_trees_give_the_same_ids():
    merges, rng = bpe.Merges(bpe.read_ranks(RANKS)), random.Random(5)
    pieces = [bytes(rng.choice(b"theanion\xc3\xa9") for _ in range(rng.randrange(1, 64))) for _ in range(500)]
    assert bpe.merge_short(pieces, 64, merges) == [bpe.merge_long(p, merges) for p in pieces]


def test_small_cache_is_refilled():
    encoder = bpe.Encoder(RANKS, P.PATTERN)
    encoder.cache.most, encoder.cache.recent = 10, 4
    for text in ("one two three four", "five six seven eight nine ten eleven", "one two twelve", "one two three four five a b", "one twelve two", "c d e f g", "one"):
        assert encoder.cache.ids([text, ""])[0].tolist() == LIBRARY.encode_ordinary(text)


def test_round_trip_of_odd_rows(docs, odd_rows):
    df = docs(odd_rows).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    rows = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(rows) == len(odd_rows)
    for row in rows:
        assert row.text is None or isinstance(row.text, str)
        assert row.ids == LIBRARY.encode_ordinary(row.text or "") and bytes(row.decoded) == (row.text or "").encode() and row.lang == "en"


def test_empty_table(docs):
    assert bpe.decode(bpe.encode(docs([]), RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0
