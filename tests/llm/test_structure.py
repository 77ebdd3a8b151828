"""Structure repair against a search over all edits, and its persistent audits against plain strings."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stampcard.llm import structure
from stampcard.llm.common import table
from stampcard.llm.queries import QUERIES
from tests.conftest import SF_SMALL

EMPTY = hashlib.sha256(b"").hexdigest()


def plain_repair(rows):
    """Cheapest audit and turns of (role, text, removed, truncated) rows: all ways as plain strings, by the pattern's states."""
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    ways = {"": (0, "", ())}

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserts(ways):
        out = dict(ways)
        for _ in range(4):
            for state, (cost, audit, turns) in list(out.items()):
                for i, to in steps[state].items():
                    if i in names:
                        put(out, to, (cost + 2, audit + "I", (*turns, names[i] + ":")))
        return out

    for role, text, removed, truncated in rows:
        new = {}
        for state, (cost, audit, turns) in inserts(ways).items():
            put(new, state, (cost + 3, audit + "D", turns))
            if removed:
                continue
            if role[:1] in steps[state]:
                put(new, steps[state][role[:1]], (cost + truncated, audit + "K", (*turns, f"{role}:{text}")))
            for i, to in steps[state].items():
                if i in names:
                    put(new, to, (cost + 2 + truncated, audit + "R", (*turns, f"{names[i]}:{text}")))
        ways = new
    cost, audit, turns = min(w for s, w in inserts(ways).items() if s in ("", "a"))
    assert re.fullmatch("(s?(ua)+)?", "".join(t[:1] for t in turns))
    return cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def exhaustive(rows, most=3):
    """The least cost and audit by trying every string of edits with up to ``most`` inserts."""
    best = None

    def go(k, cost, audit, initials, left):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best):
            best = cost, audit
        if left:
            for i in "ua":
                go(k, cost + 2, audit + "I", initials + i, left - 1)
        if k < len(rows):
            role, _, removed, truncated = rows[k]
            go(k + 1, cost + 3, audit + "D", initials, left)
            if not removed:
                if role[:1] in ("s", "u", "a"):
                    go(k + 1, cost + truncated, audit + "K", initials + role[:1], left)
                for i in "ua":
                    go(k + 1, cost + 2 + truncated, audit + "R", initials + i, left)

    go(0, 0, "", "", most)
    return best


def plain_conversation(rows):
    """Result of (turn, role, text) rows that are there, in order."""
    faults, seen, judged = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
    for _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *faults.values(), illegal, *plain_repair(judged)


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) for c, x in out.items()}


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.just("x"), st.booleans(), st.booleans()), max_size=5)


@settings(max_examples=150, deadline=None)
@given(ROWS)
def test_cheapest_edits(rows):
    repair = structure.Repair()
    for role, text, removed, truncated in rows:
        repair.add(role, text, removed, truncated and not removed)
    rows = [(r, t, d, c and not d) for r, t, d, c in rows]
    cost, audit, digest = repair.finish()
    assert (cost, audit, digest) == plain_repair(rows)
    if len(rows) <= 4:
        assert (cost, audit) == exhaustive(rows, 5)


def test_long_conversations_and_ties():
    rng = random.Random(5)
    for size in (300, 1000):
        rows = [(rng.choice(["user", "assistant", "assistant", "system", "tool"]), f"text {k}", rng.random() < 0.1, rng.random() < 0.2) for k in range(size)]
        rows = [(r, t, d, c and not d) for r, t, d, c in rows]
        repair = structure.Repair()
        for row in rows:
            repair.add(*row)
        assert repair.finish() == plain_repair(rows)


@pytest.mark.parametrize("broken", [False, True])
def test_audits_compare_as_strings(broken, monkeypatch):
    """Also with a hash that tells nothing apart but lengths: the walk back finds what it hides."""
    if broken:
        monkeypatch.setattr(structure, "_BASE", 0)
        monkeypatch.setattr(structure, "_PRIME", 1)
    rng = random.Random(3)
    nodes = [structure.Audit()]
    for _ in range(400):
        nodes.append(structure.Audit(rng.choice(nodes), rng.choice("DIKR")))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert structure.less(a, b) == (a.text() < b.text())


def test_query(spark):
    rows = [tuple(r) for r in table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    wanted = {c: plain_conversation(x) for c, x in plain_damage(rows).items()}
    got = QUERIES["op13_structure_repair"](spark, SF_SMALL).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == wanted and len(got) == len(wanted)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, None, "user", "Hello."), (1, 4, "assistant", "Yes."), (1, 4, "assistant", "Yes."), (2, 0, "", ""), (3, 7, "user", "a" * 80_000 + "."), (3, 8, "assistant", "ok!"),
        (None, 0, "user", "no conversation"), (None, None, None, None), (4, 0, "system", "Be kind."), (4, 1, "user", "Is it? "), (4, 3, "assistant", "It is\n.\n"), (5, 2, "user", "漢字。"),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, cost string, there int").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in structure.audit_conversations(frame).collect()}
    by_id = {}
    for c, t, r, x in rows:
        if c is not None:
            by_id.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    wanted = {c: plain_conversation(sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))) for c, x in by_id.items()}
    assert got == wanted
    assert structure.audit_conversations(frame.limit(0)).collect() == []
    from pyspark.sql import functions as F

    dropped = structure.audit_conversations(frame.where("conv_id = 4"), F.lit(True)).collect()
    assert [tuple(r) for r in dropped] == [(4, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def test_a_hot_conversation_holds_no_texts(spark):
    """Half of all rows in one conversation: its texts are not gathered, and the audit is still the plain one."""
    roles = ["user", "assistant", "user", "user", "assistant", "tool"]
    rows = [(1, k, roles[k % 6], f"Text {k}.") for k in range(6000)] + [(k, 0, "user", "One.") for k in range(2, 6000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.audit for r in structure.audit_conversations(frame).collect()}
    hot = [(r, t, False, False) for c, _, r, t in rows if c == 1]
    assert got[1] == plain_repair(hot)[1] and got[2] in ("KI",) and len(got) == 5999
