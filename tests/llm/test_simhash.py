"""Fingerprints and groups against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stampcard.llm import simhash
from stampcard.llm.common import table
from stampcard.llm.components import components, forest
from tests.conftest import SF_SMALL


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=4):
    """Smallest reachable index by repeated passes over all pairs."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if label[i] != label[j] and (prints[i] ^ prints[j]).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_documents_as_brute_force(spark):
    docs = sorted(table(spark, SF_SMALL, "documents").select("doc_id", "text").collect())
    prints = [plain_print(r.text) for r in docs]
    label = plain_groups(prints)
    wanted = {r.doc_id: (p, docs[k].doc_id) for r, p, k in zip(docs, prints, label)}
    found = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(table(spark, SF_SMALL, "documents")).collect()}
    assert found == wanted


def test_trees_lose_no_link(spark):
    rng = random.Random(11)
    words = [rng.getrandbits(64) for _ in range(700)] + [0, (1 << 64) - 1]
    for base in words[:150]:
        for _ in range(3):
            flipped = base
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                flipped ^= 1 << b
            words.append(flipped)
    words += [words[5] ^ (1 << b) ^ (1 << c) for b in range(24) for c in range(b)]  # a dense group
    words = sorted(set(words))
    label = plain_groups(words)
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    nodes = spark.createDataFrame([(signed(w),) for w in words], "fp long").repartition(5)
    old = simhash.SHARD_ROWS, simhash._LEAF
    simhash.SHARD_ROWS, simhash._LEAF = 100, 16
    try:
        roots = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    finally:
        simhash.SHARD_ROWS, simhash._LEAF = old
    same = lambda a, b: roots.get(a, a) == roots.get(b, b)
    by = {}
    for w, k in zip(words, label):
        by.setdefault(k, []).append(signed(w))
    assert len({roots.get(signed(w), signed(w)) for w in words}) == len(by)
    assert all(same(g[0], x) for g in by.values() for x in g)


def test_forest_keeps_components():
    rng = np.random.default_rng(2)
    left, right = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    member, root = forest(left, right)
    label = dict(zip(member.tolist(), root.tolist()))
    assert all(label.get(a, a) == label.get(b, b) for a, b in zip(left.tolist(), right.tolist()))
    assert all(r < m and r not in label for m, r in label.items())


def test_long_chain(spark):
    edges = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {(r.node, r.root) for r in components(edges).collect()} == {(n, 0) for n in range(400)}


def test_odd_rows(docs, odd_rows):
    df = docs(odd_rows).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit("x"))
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == len(odd_rows)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(docs([])).count() == 0
