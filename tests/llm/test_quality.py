"""Measurements and bits against a plain reading of the rules."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from stampcard.llm import quality
from stampcard.llm.common import table
from tests.conftest import SF_SMALL


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, repeated = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            repeated |= {i, i + 1, i + 2}
    dups = sum(1 for k, x in enumerate(lines) if x in set(lines[:k])) if len(lines) < 500 else len(lines) - len(set(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeated)


def agree(rows):
    for r in rows:
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert found == plain(r.text), (r.doc_id, found)
        assert bool(r.fail_bits & 3) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_all_documents(spark):
    agree(quality.ledger(table(spark, SF_SMALL, "documents")).collect())


def test_odd_rows(docs, odd_rows):
    df = docs([*odd_rows, (9, "a b c a b c"), (10, "a a a a"), (11, "a b c")]).withColumn("n_words", F.lit("x")).withColumn("fail_bits", F.lit("x"))
    rows = quality.ledger(df).collect()
    assert len(rows) == len(odd_rows) + 3
    agree(rows)
    assert quality.ledger(docs([])).count() == 0


def test_policies_and_ablations(docs):
    clean = " ".join(f"word{k}" for k in range(80))
    rows = [(1, clean), (2, clean.upper().replace("WORD", "WORDS")), (3, clean.replace(" ", "### ")), (4, "few words"), (5, None)]
    entries = quality.ledger(docs(rows))
    kept = lambda p, v: sorted(r.doc_id for r in entries.where(quality.verdict(p, v)).collect())
    assert kept("base", 1) == [1, 2, 3] and kept("corpus", 1) == [1, 2] and kept("corpus", 2) == [1]
    effect = {(r.policy, r.version, r.rule): (r.n_rejected, r.n_failing, r.n_only_this) for r in quality.ablations(entries).collect()}
    assert effect["corpus", 2, "capitals"] == (4, 1, 1) and effect["corpus", 1, "few_words"] == (3, 2, 2)
    assert len(effect) == sum(map(len, quality.POLICIES.values()))
