"""The trie against a plain count of all beginnings, with blocks of a few keys; layouts of the tree."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from stampcard.llm import trie


def plain_trie(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: set() for p in members}
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        words = len(re.findall(trie.WORD, p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def read_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def plain_order(rows):
    """{conv_id: turns} of (conv_id, turn, role, text) rows."""
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        if c is not None:
            out.setdefault(c, []).append((role or "", text or ""))
    return out


def plain_rebuilt(convs):
    return {c: convs.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + t[zlib.crc32(str(c).encode()) % 4 :] for c, t in convs.items()}


SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, node string"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)


def shared(n, seed=1):
    """Conversations of which many begin alike, some are equal, and some end inside others."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        size = rng.choice([1, 2, 3, 6, 30])
        for t in range(size):
            deep = rng.random() < 0.2 * t / size
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"own words {c} {t}" if deep else f"shared words {t} {rng.randint(0, 1)}"))
    return rows


@pytest.mark.parametrize("keys", [1, 3, 8192])
def test_blocks_add_up(spark, monkeypatch, keys):
    monkeypatch.setattr(trie, "BLOCK_KEYS", keys)
    rows = shared(300)
    assert read_rows(trie.prefix_trie(trie.sequences(frame_of(spark, rows)))) == plain_trie(plain_order(rows))


def test_a_third_of_all_conversations_alike(spark, monkeypatch):
    """Equal conversations spread over blocks and tasks; no block holds more than its share."""
    monkeypatch.setattr(trie, "BLOCK_KEYS", 16)
    rows = [(c, t, "user", f"the same {t}") for c in range(400) for t in range(4)] + [(c, 0, "user", f"other {c}") for c in range(400, 800)]
    convs = trie.sequences(frame_of(spark, rows))
    assert trie.blocks(convs).selectExpr("max(size(keys)) AS n").first().n == 16
    assert trie.blocks(convs).where("exists(keys, k -> length(k) = 64)").selectExpr("count(DISTINCT part) AS n").first().n > 1
    assert read_rows(trie.prefix_trie(convs)) == plain_trie(plain_order(rows))


def test_rebuilt_conversations(spark):
    rows = [(c, t, "user", f"{c} says {t}") for c in [*range(0, 45), 61, 62, 1000, 1003, *range(2001, 2018, 4)] for t in range(1 if c > 2000 else c % 4 + 1)]
    got = read_rows(trie.prefix_trie(trie.rebuilt(trie.sequences(frame_of(spark, rows)))))
    wanted = plain_rebuilt(plain_order(rows))
    assert any(not t for t in wanted.values()) and got == plain_trie(wanted)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (2, None, "", ""), (2, 0, "user", None), (2, 0, "user", None), (3, 5, "a", "x" * 70_000), (None, 0, "user", "none"), (4, 0, "ab", "c"), (5, 0, "a", "bc"),
        (9, 1, "user", "漢字 \x0b two"), (10, 1, "user", "漢字 \x0b two"), (10, 1, "user", "漢字 \x0b two"),
    ]
    frame = frame_of(spark, rows)
    assert read_rows(trie.prefix_trie(trie.sequences(frame))) == plain_trie(plain_order(rows))
    assert trie.prefix_trie(trie.rebuilt(trie.sequences(frame.limit(0)))).collect() == []


def test_layouts_grow():
    """Children in byte order and found again through all four layouts."""
    for n in (1, 4, 5, 16, 17, 48, 49, 256):
        some = random.Random(n).sample(range(256), n)
        layout = trie.Few()
        for b in some:
            layout = layout.put(b, f"child {b}")
        assert layout.children() == [f"child {b}" for b in sorted(some)]
        assert all(layout.find(b) == (f"child {b}" if b in some else None) for b in range(256))
        assert (type(layout).__name__, getattr(layout, "most", 0)) == (("Few", 4) if n <= 4 else ("Few", 16) if n <= 16 else ("Indexed", 0) if n <= 48 else ("Direct", 0))


@pytest.mark.parametrize("width", [1, 2, 16])
def test_nodes_only_at_turns(width):
    """Keys that part in the middle of an id, at any byte; paths split and ends lie inside paths."""
    rng = random.Random(width)
    ids = [bytes(rng.choice([0, 1, 255]) for _ in range(width)) for _ in range(6)]
    keys = sorted(b"".join(rng.choice(ids) for _ in range(rng.randint(0, 5))) for _ in range(200))
    nodes = trie.turn_nodes(keys, [[1] * (len(k) // width) for k in keys], None, None, width)
    wanted = {k[: d * width] for k in keys for d in range(len(k) // width + 1)}
    assert len(nodes) == len(wanted) and {keys[n.row][: n.depth * width] for n in nodes} == wanted
    assert all(n.size == sum(k.startswith(keys[n.row][: n.depth * width]) for k in keys) for n in nodes)
    assert all(sorted(n.ends) == [r for r, k in enumerate(keys) if k == keys[n.row][: n.depth * width]] for n in nodes)
