"""Conversation structure repair with an audit of the edits.

``audit_conversations`` takes one row a turn and finds the cheapest edits that make the roles of a conversation read
``(s?(ua)+)?`` (initials of system, user, assistant). In order of the rows: Keep costs 0, Rerole to user or assistant 2, Delete 3 (the
only edit for a blank or repeated row); Insert puts an empty turn of user or assistant anywhere for 2; a truncated row that stays adds 1.
The audit is the edits' initials in order; of equally cheap ones the least in ASCII order wins, and it fixes the roles of inserted turns.

The dynamic program has four states: nothing yet, after the system turn, after a user, after an assistant. Each keeps its cheapest audit as a
node of a persistent list: nodes share their prefixes, hold the ancestors 2^k edits back (binary lifting) and a rolling hash of the
edits so far. Two audits of equal cost are compared by the longest common prefix: lifting goes up while hashes differ, and the first
edits that differ decide. Prefixes that the hashes call equal are walked back to a common node and compared edit by edit; if they prove
different, the whole audits are compared instead.

Rows stream through the program sorted by conversation, and each state carries the running SHA-256 of its repaired turns, so
no text is held: a task holds the audit nodes and one digest for each different row of the conversation it is at. A conversation is in one task,
as its audit and digest are sequential.

Order within a conversation: turn (nulls first), then role, then text; repeated rows stand next to each other. Null roles and texts are
one space, so a row with a null text is blank. A row without a conversation id belongs to no conversation and is left out. Rows marked in
``gone`` only name their conversation: one with no other rows has zeros, an empty audit and the digest of nothing. Roles are read by
their first character; any other than s, u, a (an empty role too) can't be kept. Texts of any length are read once; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}
#: The rolling hash: a prime modulus, and a base that no input is made to fit.
_PRIME, _BASE = (1 << 61) - 1, 0x1D8AF066F4A2B5C3 % ((1 << 61) - 1)
#: Roles by state, and the state that each turn of a role leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_NAMES = {"u": "user", "a": "assistant"}


class Audit:
    """The last edit of an audit; ``up[k]`` is the audit 2^k edits shorter."""

    __slots__ = ("edit", "size", "value", "up")

    def __init__(self, before: Audit | None = None, edit: str = ""):
        self.edit = edit
        if before is None:
            self.size = self.value = 0
            self.up: list[Audit] = []
            return
        self.size = before.size + 1
        self.value = (before.value * _BASE + ord(edit)) % _PRIME
        self.up = [before]
        for k in range(self.size.bit_length() - 1):
            older = self.up[k].up
            if k >= len(older):
                break
            self.up.append(older[k])

    def shorter(self, size: int) -> Audit:
        """The ancestor of that many edits."""
        node = self
        while node.size > size:
            node = node.up[(node.size - size).bit_length() - 1]
        return node

    def text(self) -> str:
        out, node = [], self
        while node.size:
            out.append(node.edit)
            node = node.up[0]
        return "".join(reversed(out))


def _same(a: Audit, b: Audit) -> bool:
    """Whether two audits of equal size and hash are equal, edit by edit back to a common node. Equal ones share their past from then on."""
    x, y = a, b
    while x is not y:
        if x.edit != y.edit:
            return False
        x, y = x.up[0], y.up[0]
    if a is not b:
        a.up = b.up
    return True


def less(a: Audit, b: Audit) -> bool:
    """Whether the edits of ``a`` come before those of ``b``; neither is the beginning of the other."""
    if a is b:
        return False
    size = min(a.size, b.size)
    x, y = a.shorter(size), b.shorter(size)
    if x.value == y.value:
        if _same(x, y):
            return a.size < b.size
        return a.text() < b.text()
    for k in range(min(len(x.up), len(y.up)) - 1, -1, -1):
        if k < len(x.up) and k < len(y.up) and x.up[k].value != y.up[k].value:
            x, y = x.up[k], y.up[k]
    if not _same(x.up[0], y.up[0]):
        return a.text() < b.text()
    return x.edit < y.edit


class Way:
    """The cheapest audit that ends in a state: its cost, its edits, and the digest of the turns it leaves."""

    __slots__ = ("cost", "audit", "digest")

    def __init__(self, cost: int, audit: Audit, digest):
        self.cost, self.audit, self.digest = cost, audit, digest

    def turn(self, role: str, text: bytes):
        """The digest with one more turn."""
        out = hashlib.sha256() if self.digest is None else self.digest.copy()
        out.update((b"" if self.digest is None else b"\n") + role.encode() + b":" + text)
        return out


class Repair:
    """The program over the rows of one conversation, in order."""

    def __init__(self):
        self.ways: list[Way | None] = [Way(0, Audit(), None), None, None, None]

    def _offer(self, best: list, state: int, way: Way, cost: int, edit: str, role: str | None, text: bytes) -> None:
        """Keep the step in ``best`` if it beats what stands there; a step is (cost, audit, way, role, text)."""
        held = best[state]
        cost += way.cost
        if held is not None and cost > held[0]:
            return
        audit = Audit(way.audit, edit)
        if held is None or cost < held[0] or less(audit, held[1]):
            best[state] = (cost, audit, way, role, text)

    @staticmethod
    def _way(step) -> Way | None:
        if step is None or isinstance(step, Way):
            return step
        cost, audit, way, role, text = step
        return Way(cost, audit, way.digest if role is None else way.turn(role, text))

    def _inserts(self) -> None:
        """Turns put in between: from any state to user, from user to assistant. More of them never pay."""
        for state, role, sources in ((USER, "user", (START, SYSTEM, ASSISTANT)), (ASSISTANT, "assistant", (USER,))):
            here = self.ways[state]
            best: list = [None] * 4
            for source in sources:
                if (way := self.ways[source]) is not None and (here is None or way.cost + INSERT <= here.cost):
                    self._offer(best, state, way, INSERT, "I", role, b"")
            step = best[state]
            if step is not None and (here is None or step[0] < here.cost or less(step[1], here.audit)):
                self.ways[state] = self._way(step)

    def add(self, role: str, text: str, removed: bool, truncated: bool) -> None:
        """One more row; ``removed``: it may only be deleted."""
        self._inserts()
        best: list = [None] * 4
        raw = b"" if removed else text.encode()
        more = TRUNCATED if truncated else 0
        for state, way in enumerate(self.ways):
            if way is None:
                continue
            self._offer(best, state, way, DELETE, "D", None, b"")
            if removed:
                continue
            after = _NEXT[state].get(role[:1])
            if after is not None:
                self._offer(best, after, way, KEEP + more, "K", role, raw)
            for initial, to in _NEXT[state].items():
                if initial in _NAMES:
                    self._offer(best, to, way, REROLE + more, "R", _NAMES[initial], raw)
        self.ways = [self._way(step) for step in best]

    def finish(self) -> tuple[int, str, str]:
        """Cost, audit and hex digest of the repaired turns."""
        self._inserts()
        nothing, full = self.ways[START], self.ways[ASSISTANT]
        best = nothing
        if full is not None and (nothing is None or full.cost < nothing.cost or (full.cost == nothing.cost and less(full.audit, nothing.audit))):
            best = full
        return best.cost, best.audit.text(), (best.digest or hashlib.sha256()).hexdigest()


class Conversation:
    """Counts and repair of one conversation, row by row."""

    def __init__(self):
        self.repair, self.seen = Repair(), set()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial = 0, None
        self.first = self.last = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        body = text.strip(SPACES)
        row = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        fault = "blank" if not body else "duplicate" if row in self.seen else "truncated" if body[-1] not in ENDS else None
        self.seen.add(row)
        if fault:
            self.faults[fault] += 1
        self.repair.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, audit, digest = self.repair.finish()
        return gaps, *self.faults.values(), self.illegal, cost, audit, digest


FOUND = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], T.StructField("audit", T.StringType()),
    T.StructField("repaired_sha256", T.StringType()),
])
_SLICE = 4096


def audit_conversations(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of ``conv_id, turn, role, text``.

    ``gone``: rows that are not there any more, but whose conversation is."""
    there = F.lit(True) if gone is None else ~gone
    spoken = [F.coalesce(F.when(there, F.col(c)), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.when(there, F.col("turn")).cast("long").alias("turn"), *spoken, there.alias("there"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *FOUND.fields])
    arrow = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out, at, talk = [], [], None, None

        def ready() -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), arrow)]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *columns], names=schema.names)

        for batch in batches:
            id_type = batch.column("conv_id").type
            for a in range(0, batch.num_rows, _SLICE):
                part = batch.slice(a, _SLICE)
                for conv, turn, role, text, here in zip(*(c.to_pylist() for c in part.columns)):
                    if talk is None or conv != at:
                        if talk is not None:
                            ids.append(at)
                            out.append(talk.result())
                        at, talk = conv, Conversation()
                    if here:
                        talk.add(turn, role, text)
                if out:
                    yield ready()
                    ids, out = [], []
        if talk is not None:
            ids.append(at)
            out.append(talk.result())
            yield ready()

    return dealt.mapInArrow(run, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, gone`` with faults by ``crc32(conv_id:turn) % 20`` (a null turn as one space): 0 drops the row, 1 empties the text, 2
    takes out its sentence ends, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), copies.alias("copy")).drop("copy")
