"""Spans against a plain reading; the models on held-out samples."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from stampcard.llm import secrets
from stampcard.llm.common import table
from tests.conftest import SF_ORACLE, SF_SMALL


def plain(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.labelled_samples(table(spark, SF_ORACLE, "documents"), most=600))


def plain_score(run, model):
    at = [secrets.ALPHABET.index(c) for c in run]
    return sum(model[a * len(secrets.ALPHABET) + b] for a, b in zip(at, at[1:]))


def plain_spans(text, model):
    base = plain(text)
    runs = [(m.start(), 3, m.end()) for m in re.finditer(secrets.RUN, text or "") if plain_score(m[0], model) > secrets.PRIOR]
    return sorted(base + [r for r in runs if not any(b[0] < r[2] and r[0] < b[2] for b in base)])


def test_all_documents(spark, model):
    rows = secrets.find_secrets(table(spark, SF_ORACLE, "documents"), model).collect()
    for r in rows:
        assert [tuple(s) for s in r.base] == plain(r.text)
        assert [tuple(s) for s in r.spans] == plain_spans(r.text, model)
    assert any(r.base for r in rows)


def test_odd_rows(docs, odd_rows, model):
    texts = [
        "token=abc token=abcdef", "secret=token:abcdefgh", 'API_KEY" : "a.b-c=/+_', "é\x01token=\x01 password='Ünï", "AKIA" + "Z" * 16, "AKIAAKIA", "x" + "0123456789abcdef" * 2 + "g",
        "apikey==========", "TOKEN:    deadbeef" + "0" * 30, "🙂" * 50 + "passwd=abcdef" + "🙂", "zQ3x9Lk0pV7bT2mR8nW4yJ6cH1", "ordinarywordsjoinedtogether", "a" * 30_000, "tokenized: abcdefgh",
    ]
    rows = [*odd_rows, *((100 + k, t) for k, t in enumerate(texts))]
    df = docs(rows).withColumn("base", F.lit(1)).withColumn("spans", F.lit(1))
    found = secrets.find_secrets(df, model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(s) for s in r.base] == plain(r.text) and [tuple(s) for s in r.spans] == plain_spans(r.text, model)
    by = {r.doc_id: r.spans for r in found}
    assert [s.kind for s in by[110]] == [3] and by[111] == []
    assert secrets.find_secrets(docs([]), model).count() == 0


def test_many_matches_in_one_text(docs, model):
    """The time grows with the matches, not with their square; spans hold over the borders of blocks."""
    import time

    took = []
    for n in (20_000, 80_000):
        text = " ".join(f"{k:024x}" for k in range(n)) + " token=abcdef"
        start = time.time()
        spans = secrets.find_secrets(docs([(1, text)]), model).select(F.size("base").alias("n"), F.element_at("base", -2).alias("last"), F.expr("base[255]").alias("inner")).first()
        took.append(time.time() - start)
        assert spans.n == n + 1 and tuple(spans.last) == (25 * (n - 1), 2, 25 * n - 1) and tuple(spans.inner) == (25 * 255, 2, 25 * 255 + 24)
    assert took[1] < 8 * took[0] + 5


def test_held_out_accuracy(spark, model):
    rng = random.Random(9)
    words = [w for r in table(spark, SF_SMALL, "documents").select("text").collect() for w in re.findall("[A-Za-z]{5,}", r.text)]
    ordinary = ["".join(rng.choice(words) for _ in range(4)) for _ in range(2000)]
    made = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(500)] + [base64.b64encode(rng.randbytes(24)).decode() for _ in range(500)]
    made += ["".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(32)) for _ in range(500)]
    wrong = sum(plain_score(x, model) > secrets.PRIOR for x in ordinary)
    caught = sum(plain_score(x, model) > secrets.PRIOR for x in made)
    assert wrong <= 0.01 * len(ordinary) and caught >= 0.99 * len(made)


def test_no_samples(spark, docs):
    assert set(secrets.train(secrets.labelled_samples(docs([])))) == {0.0}
