"""Benchmark items inside documents, also with other numbers, names and units.

A text is canonicalised twice. In both forms numbers (digits or words) and the units after them are typed placeholders and other words
are lower-case without edge punctuation; in one form capitalised words are name placeholders as well. Windows of ``WINDOW`` tokens
that hold at least ``LITERALS`` words become hashes; the windows of documents meet those of the items in a hash join. The join is left
to the planner: benchmark windows are broadcast if their stored size allows, and shuffled otherwise.

A document and an item that share enough windows are compared token by token along each alignment. Slots must be consistent: of the
aligned placeholders at least ``SIMILARITY`` must map the item's value to the document value that it mostly maps to. The item is in the document
if consistent alignments cover ``SIMILARITY`` of its tokens, or one covers a stretch of ``RUN`` tokens without a gap.

Items that these windows would not find in a copy of themselves (too few words among numbers and names, too few tokens, scripts without spaces) are
searched word by word instead: their units (words and numbers as they are, each character of a script without spaces) are found by windows of
``WINDOW`` units and must all follow in the document. Items of fewer than ``WINDOW`` units are never found, as they stand in texts that have nothing to do with them.
An empty table on either side gives no leak; texts of any length are read whole; of ties between alignments each counts by itself. Null or empty texts hold nothing, and items with a null id are left out. Rows
that repeat both id and text are one document and get the same result; other columns pass through, except those named like the output's.
"""

from __future__ import annotations

import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stampcard.llm.common import list_array, row_key, slices
from stampcard.session import materialize

WINDOW = 5
LITERALS = 2
SIMILARITY = 0.8
RUN = 13

NUMBER_WORDS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split())
UNITS = set("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents mph kmh hz khz mhz ghz kb mb gb tb w kw kwh v degrees celsius fahrenheit percent".split())

LITERAL, NUMBER, UNIT, NAME, GLUED = 1, 2, 3, 4, 5
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_GLUED = re.compile(r"(\d)([A-Za-z])")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Words, and single characters of scripts that have no spaces (Thai, Lao, Burmese, Khmer, kana, Han).
_UNIT = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|(?:(?![\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff])[^\\W_])+")
_MARKS = np.array([0, 0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0], np.uint64)


def core(word: str) -> str:
    """The word without punctuation at its edges; most words need no pattern for that."""
    inner = word.strip(string.punctuation)
    return inner if inner.isalpha() else _EDGES.sub("", word)


class Words(dict):
    """Place of each raw word in arrays of kind, capital and code, and of the parts of each glued word; filled as words are met."""

    def __init__(self):
        self.kinds, self.capitals, self.codes = bytearray(), bytearray(), []
        self.parts: dict[int, list[int]] = {}

    def __missing__(self, word: str) -> int:
        inner = core(word)
        low = inner.lower()
        plain = inner.isalpha()
        if not plain and _GLUED.search(word):
            kind = GLUED  # to be cut before use
        elif not inner:
            kind = 0
        elif low in NUMBER_WORDS or not plain and _NUMBER.fullmatch(inner):
            kind = NUMBER
        else:
            kind = UNIT if low in UNITS else LITERAL
        parts = [self[x] for x in raw_words(word)] if kind == GLUED else None  # these are not glued again
        self.kinds.append(kind)
        self.capitals.append(kind == LITERAL and inner[0].isupper())
        self.codes.append(xxhash.xxh64_intdigest(low))
        place = self[word] = len(self.kinds) - 1
        if parts:
            self.parts[place] = parts
        return place

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(bytes(self.kinds), np.uint8), np.frombuffer(bytes(self.capitals), bool), np.array(self.codes, np.uint64)


def raw_words(text: str) -> list[str]:
    return _GLUED.sub(r"\1 \2", text).split()


class Tokens:
    """Canonical tokens of one text: ``kind`` with names as words, ``capital``, ``code``, and the place of each in the raw words."""

    def __init__(self, places: np.ndarray, kinds: np.ndarray, capitals: np.ndarray, codes: np.ndarray):
        kind = kinds[places]
        self.word = np.flatnonzero(kind)
        kind = kind[self.word]
        after_number = np.concatenate([[False], kind[:-1] == NUMBER]) if len(kind) else np.zeros(0, bool)
        self.kind = np.where((kind == UNIT) & ~after_number, LITERAL, kind)
        self.capital, self.code = capitals[places[self.word]], codes[places[self.word]]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return hash_windows(self.kind, self.capital, self.code, np.zeros(len(self.kind), np.int64))


def hash_windows(kind: np.ndarray, capital: np.ndarray, code: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that lie in one text, folded and with names as slots; 0 where there are too few words, or no name in
    the second. ``text`` numbers the text of each token."""
    n = max(0, len(kind) - WINDOW + 1)
    out = []
    for form in (kind, np.where(capital, NAME, kind)):
        value = np.where(form == LITERAL, code, _MARKS[form])
        word = (form == LITERAL).astype(np.int8)
        hashes, words, multiplier = np.zeros(n, np.uint64), np.zeros(n, np.int8), 0x9E3779B185EBCA87
        for k in range(WINDOW):
            hashes += value[k : k + n] * np.uint64(pow(multiplier, k + 1, 1 << 64))
            words += word[k : k + n]
        hashes[words < LITERALS] = 0
        out.append(hashes.view(np.int64))
    out[1][out[1] == out[0]] = 0
    whole = text[:n] == text[len(text) - n :] if n else np.zeros(0, bool)
    return out[0][whole], out[1][whole]


def windows_of(texts: list[str], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each text its folded windows, then those with names as slots, all in one array; and how many windows each text has."""
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    places = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    text = np.repeat(np.arange(len(texts)), counts)
    kinds, capitals, codes = known.arrays()
    glued = np.flatnonzero(kinds[places] == GLUED)
    if len(glued):
        parts = [known.parts[p] for p in places[glued].tolist()]
        wide = np.ones(len(places), np.int64)
        wide[glued] = [len(p) for p in parts]
        part_of = np.repeat(glued, wide[glued])
        within = np.arange(len(part_of)) - np.repeat(np.cumsum(wide[glued]) - wide[glued], wide[glued])
        places, text = np.repeat(places, wide), np.repeat(text, wide)
        places[(np.cumsum(wide) - wide)[part_of] + within] = np.fromiter(chain.from_iterable(parts), np.int64, len(part_of))
    kind = kinds[places]
    used = np.flatnonzero(kind)
    kind, text, places = kind[used], text[used], places[used]
    first = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
    after_number = np.concatenate([[False], kind[:-1] == NUMBER])[: len(kind)] & ~first
    kind = np.where((kind == UNIT) & ~after_number, LITERAL, kind)
    folded, named = hash_windows(kind, capitals[places], codes[places], text)
    sizes = np.maximum(np.bincount(text, minlength=len(texts)) - WINDOW + 1, 0)
    start = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(folded)) + start[of]
    flat = np.zeros(2 * len(folded), np.int64)
    flat[at], flat[at + sizes[of]] = folded, named
    return flat, sizes


def tokens_of(texts: list[str], known: Words) -> list[Tokens]:
    places = [np.fromiter(map(known.__getitem__, raw_words(t)), np.int64) for t in texts]  # raw words are never glued
    arrays = known.arrays()
    return [Tokens(p, *arrays) for p in places]


def window_table(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``key, pos, h, folded``: every window of every text, in one or both forms."""
    schema = T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField("n", T.IntegerType()), T.StructField("hs", T.ArrayType(T.LongType(), False))])
    picked = df.select(F.col(key).alias("k"), F.col(text_col).alias("body"))

    def run(batches):
        known = Words()
        for part, texts in slices(batches, "body"):
            if len(known) > 300_000:
                known = Words()
            flat, sizes = windows_of(texts, known)
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(sizes, pa.int32()), list_array(flat, 2 * sizes, pa.int64())], names=schema.names)

    made = picked.where("body IS NOT NULL AND body <> ''").mapInArrow(run, schema)
    rows = made.select("k", "n", F.posexplode("hs").alias("at", "h")).where("h <> 0")
    return rows.select(F.col("k").alias(key), F.expr("at % n").alias("pos"), "h", (F.col("at") < F.col("n")).alias("folded"))


def aligned(doc: Tokens, item: Tokens, doc_words: list[str], item_words: list[str], similarity: float = SIMILARITY, run: int = RUN) -> tuple[float, int]:
    """Share of the item's tokens that consistent alignments cover, and the longest stretch that one of them covers."""
    size = len(item.kind)
    hits: list[np.ndarray] = []
    for own, theirs in zip(doc.windows(), item.windows()):
        order = np.argsort(own, kind="stable")
        low, high = np.searchsorted(own[order], theirs, "left"), np.searchsorted(own[order], theirs, "right")
        counts = np.where(theirs != 0, high - low, 0)
        at = np.repeat(np.arange(len(theirs)), counts)
        offset = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        hits.append(np.stack([order[low[at] + offset] - at, at], axis=1))
    pairs = np.unique(np.concatenate(hits), axis=0)
    covered, longest = np.zeros(size, bool), 0
    for shift in np.unique(pairs[:, 0]):
        own = np.zeros(size, bool)
        for at in pairs[pairs[:, 0] == shift, 1]:
            own[at : at + WINDOW] = True
        places = np.flatnonzero(own)
        kinds = np.where(item.capital & doc.capital[np.clip(np.arange(size) + shift, 0, len(doc.kind) - 1)], NAME, item.kind)
        slots = [(kinds[p], core(item_words[item.word[p]]), core(doc_words[doc.word[p + shift]])) for p in places if kinds[p] != LITERAL]
        seen: dict[tuple, dict[str, int]] = {}
        for kind, mine, theirs in slots:
            values = seen.setdefault((kind, mine), {})
            values[theirs] = values.get(theirs, 0) + 1
        if sum(max(v.values()) for v in seen.values()) < similarity * len(slots):
            continue
        covered |= own
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        longest = max(longest, int((edges[1::2] - edges[::2]).max(initial=0)))
    return float(covered.mean()) if size else 0.0, longest


def units(text: str) -> list[str]:
    return _UNIT.findall(text.lower())


def found_in_itself(text: str) -> bool:
    """Whether the windows of an item find a copy of it."""
    own, words = tokens_of([text], Words())[0], raw_words(text)
    coverage, longest = aligned(own, own, words, words)
    return coverage >= SIMILARITY or longest >= RUN


class UnitCodes(dict):
    def __missing__(self, unit: str) -> int:
        code = self[unit] = xxhash.xxh64_intdigest(unit)
        return code


def unit_windows(df: DataFrame, key: str, text_col: str, first_only: bool) -> DataFrame:
    """``key, h``: the different windows of ``WINDOW`` units of each text, or its first one."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("hs", T.ArrayType(T.LongType(), False))])

    def run(batches):
        codes = UnitCodes()
        for part, texts in slices(batches, text_col):
            if len(codes) > 300_000:
                codes = UnitCodes()
            hashes = []
            for text in texts:
                code = np.fromiter(map(codes.__getitem__, units(text)), np.uint64)
                n = min(max(0, len(code) - WINDOW + 1), 1 if first_only else len(code))
                h = np.zeros(n, np.uint64)
                for k in range(WINDOW):
                    h += code[k : k + n] * np.uint64(pow(0x9E3779B185EBCA87, k + 1, 1 << 64))
                hashes.append(np.unique(h).view(np.int64))
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(key), list_array(flat, np.array([len(h) for h in hashes], np.int64), pa.int64())], names=schema.names)

    return df.select(key, text_col).where(f"`{text_col}` <> ''").mapInArrow(run, schema).select(key, F.explode("hs").alias("h"))


def exact_leaks(keyed: DataFrame, known: DataFrame) -> DataFrame | None:
    """``rk, item, coverage, run`` of the items that the windows of ``leaks`` miss; None if there are no such items."""

    def missed(batches):
        for part, texts in slices(batches, "item_text"):
            yield part.filter(pa.array([not found_in_itself(t) for t in texts], pa.bool_()))

    asked = materialize(known.mapInArrow(missed, known.schema), "exact-items")
    if asked.isEmpty():
        return None
    starts = materialize(unit_windows(asked, "item", "item_text", True).distinct(), "exact-windows")
    met = unit_windows(keyed, "rk", "body", False).join(starts, "h").select("rk", "item").distinct().join(asked, "item")
    candidates = materialize(met.groupBy("rk").agg(F.collect_list(F.struct("item", "item_text")).alias("asked")), "exact-candidates")
    found = T.StructType([T.StructField("rk", T.LongType()), T.StructField("item", known.schema["item"].dataType), T.StructField("coverage", T.DoubleType()), T.StructField("run", T.LongType())])

    def verify(batches):
        for part, texts in slices(batches, "body"):
            out = []
            for rk, text, items_ in zip(part.column("rk").to_pylist(), texts, part.column("asked").to_pylist()):
                line = " " + " ".join(units(text)) + " "
                for x in items_:
                    own = units(x["item_text"])
                    if " " + " ".join(own) + " " in line:
                        out.append((rk, x["item"], 1.0, len(own)))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = [pa.int64(), part.column("asked").type.value_type.field(0).type, pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=found.names)

    return keyed.join(candidates, "rk").select("rk", "body", "asked").mapInArrow(verify, found)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``rk, item, coverage, run``: one row for each document (by row key) and item in it."""
    known = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("item_text")).where("item IS NOT NULL AND item_text IS NOT NULL")
    wanted = materialize(window_table(known, "item", "item_text").distinct(), "benchmark-windows")
    sizes = wanted.groupBy("item").agg(F.countDistinct("pos").alias("n_windows"))
    keyed = docs.select(row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("body"))
    mine = window_table(keyed, "rk", "body").select("rk", "h", "folded")
    met = mine.join(wanted.withColumnRenamed("pos", "item_pos"), ["h", "folded"]).groupBy("rk", "item", "item_pos").agg(F.lit(1).alias("one"))
    shared = met.groupBy("rk", "item").agg(F.count("*").alias("n")).join(sizes, "item")
    # no fewer windows can cover a stretch, or the share of a text that has at least these windows
    least = F.least(F.lit(-(-RUN // WINDOW)), F.ceil((F.col("n_windows") + WINDOW - 1) * SIMILARITY / WINDOW))
    candidates = shared.where(F.col("n") >= least).select("rk", "item").join(known, "item")
    asked = materialize(candidates.groupBy("rk").agg(F.collect_list(F.struct("item", "item_text")).alias("asked")), "benchmark-candidates")
    found = T.StructType([T.StructField("rk", T.LongType()), T.StructField("item", known.schema["item"].dataType), T.StructField("coverage", T.DoubleType()), T.StructField("run", T.LongType())])

    def verify(batches):
        for part, texts in slices(batches, "body"):
            known_words, out = Words(), []
            for rk, text, asked_ in zip(part.column("rk").to_pylist(), texts, part.column("asked").to_pylist()):
                doc, *items_ = tokens_of([text, *(x["item_text"] for x in asked_)], known_words)
                words = raw_words(text)
                for x, item in zip(asked_, items_):
                    coverage, longest = aligned(doc, item, words, raw_words(x["item_text"]))
                    if coverage >= SIMILARITY or longest >= RUN:
                        out.append((rk, x["item"], coverage, longest))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = [pa.int64(), part.column("asked").type.value_type.field(0).type, pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=found.names)

    by_windows = keyed.join(asked, "rk").select("rk", "body", "asked").mapInArrow(verify, found)
    exact = exact_leaks(keyed, known)
    if exact is None:
        return by_windows.distinct()
    return by_windows.unionByName(exact).groupBy("rk", "item").agg(F.max("coverage").alias("coverage"), F.max("run").alias("run"))


def mark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` with ``item_ids`` (sorted ids of the items inside) and ``contaminated``."""
    found = leaks(docs, items, id_col, text_col, **names)
    listed = materialize(found.groupBy("rk").agg(F.array_sort(F.collect_set("item")).alias("__items")), "benchmark-leaks").withColumnRenamed("rk", "__rk")
    kept = [c for c in docs.columns if c.lower() not in ("item_ids", "contaminated")]
    joined = docs.select(*[F.col(f"`{c}`") for c in kept], row_key(id_col, text_col).alias("__rk")).join(listed, "__rk", "left")
    none = F.array().cast(listed.schema["__items"].dataType)
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("__items", none).alias("item_ids"), F.col("__items").isNotNull().alias("contaminated"))
