"""Leaks against a plain reading, and re-parameterised questions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from stampcard.llm import contamination as c
from stampcard.llm.common import table
from tests.conftest import SF_SMALL

ITEM = "Tom has 12 red apples and walks 5 km to the old market with Mary before he sells every apple for 3 dollars to a farmer named Bill."
OTHER = "Anna has 40 red apples and walks 9 miles to the old market with Joan before he sells every apple for seven euros to a farmer named Otto."
SWAPPED = "Tom has 12 red apples, Tom walks 5 km with 12 friends, Tom eats 12 pears and Tom walks 5 km home with 12 friends."
BROKEN = "Ann has 31 red apples, Bob walks 6 miles with 42 friends, Cid eats 53 pears and Dan walks 7 feet home with 64 friends."


def plain_tokens(text):
    out = []
    for word in re.sub(r"(\d)([A-Za-z])", r"\1 \2", text).split():
        inner = re.sub(r"^[\W_]+|[\W_]+$", "", word)
        if not inner:
            continue
        if re.fullmatch(r"[+-]?\d[\d.,:/]*", inner) or inner.lower() in c.NUMBER_WORDS:
            kind = "#"
        elif inner.lower() in c.UNITS and out and out[-1][0] == "#":
            kind = "u"
        else:
            kind = "w"
        out.append((kind, inner, kind == "w" and inner[0].isupper()))
    return out


def plain_windows(tokens):
    found = []
    for form in (0, 1):
        codes = [inner.lower() if kind == "w" and not (form and cap) else ("N", kind) for kind, inner, cap in tokens]
        windows = {k: tuple(codes[k : k + 5]) for k in range(len(codes) - 4)}
        found.append({k: w for k, w in windows.items() if sum(isinstance(x, str) for x in w) >= 2})
    return found


def plain_leak(text, item):
    doc, own = plain_tokens(text or ""), plain_tokens(item)
    alignments = {}
    for a, b in zip(plain_windows(doc), plain_windows(own)):
        where = {}
        for p, w in a.items():
            where.setdefault(w, []).append(p)
        for k, w in b.items():
            for p in where.get(w, []):
                alignments.setdefault(p - k, set()).update(range(k, k + 5))
    covered, longest = set(), 0
    for shift, places in alignments.items():
        values, slots = {}, 0
        for p in places:
            (kind, mine, cap), (_, theirs, cap2) = own[p], doc[p + shift]
            if kind != "w" or (cap and cap2):
                slots += 1
                seen = values.setdefault((kind, mine), {})
                seen[theirs] = seen.get(theirs, 0) + 1
        if sum(max(v.values()) for v in values.values()) < 0.8 * slots:
            continue
        covered |= places
        run = 0
        for p in range(len(own)):
            run = run + 1 if p in places else 0
            longest = max(longest, run)
    return bool(own) and (len(covered) / len(own) >= 0.8 or longest >= 13)


HAN = "[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]"


def plain_exact(text, item):
    """Word for word, for items that are not found in themselves."""
    cut = lambda t: re.findall(r"[^\W_]+", re.sub(f"({HAN})", r" \1 ", t.lower()))
    doc, own = cut(text or ""), cut(item)
    return len(own) >= 5 and any(doc[k : k + len(own)] == own for k in range(len(doc) - len(own) + 1))


def plain_both(text, item):
    return plain_leak(text, item) or not plain_leak(item, item) and plain_exact(text, item)


def agree(rows, items):
    for r in rows:
        assert r.item_ids == sorted(i for i, t in items if plain_both(r.text, t)), r.doc_id
        assert r.contaminated == bool(r.item_ids)


def test_all_documents(spark):
    items = table(spark, SF_SMALL, "benchmark")
    rows = c.mark(table(spark, SF_SMALL, "documents"), items).collect()
    agree(rows, [(r.item_id, r.text) for r in items.collect()])
    assert 0 < sum(r.contaminated for r in rows) < 30


def test_parameters_slots_and_odd_rows(spark, docs, odd_rows):
    items = [(7, ITEM), (8, SWAPPED), (9, "too short to find"), (10, None), (11, ""), (12, "the same word " * 8), (13, "x 1 2 3 4 5 6 7")]
    texts = [
        ITEM, "Some text first. " + OTHER + " And more.", ITEM.lower(), ITEM.upper(), SWAPPED, BROKEN, " ".join(ITEM.split()[:14]), " ".join(ITEM.split()[:9]),
        ITEM.replace("5 km", "5km"), ITEM.replace(" ", "\n"), "five unrelated words stand here", (ITEM + " ") * 40,
    ]
    rows = [*odd_rows, *((100 + k, t) for k, t in enumerate(texts)), (100, ITEM)]
    df = docs(rows).withColumn("item_ids", F.lit(1)).withColumn("h", F.lit(1)).withColumn("item", F.lit(1))
    table_ = spark.createDataFrame([*items, (None, ITEM)], "item_id long, text string").withColumn("doc_id", F.lit(5))
    found = c.mark(df, table_).collect()
    assert len(found) == len(rows) and all(r.h == 1 for r in found)
    agree(found, [(i, t or "") for i, t in items])
    by = {r.doc_id: r.item_ids for r in found}
    assert by[100] == by[101] == by[102] == by[108] == by[109] == by[111] == [7] and by[104] == [8]
    assert by[105] == [] and by[106] == [7] and by[107] == by[110] == []


def test_items_without_enough_windows(spark, docs, odd_rows):
    """Number-dense items, names only, six short words, a text without spaces; a hot window that many items share."""
    items = [(1, "x 1 2 3 4 5 6 7"), (2, "3.5 + 4 = 7.5, 9 - 2 = 7"), (3, "Paris London Rome Oslo Bern Kyiv"), (4, "\u6771\u4eac\u306f\u65e5\u672c\u306e\u9996\u90fd\u3067\u3059"), (5, "yes"), (6, "a b c d"), (7, ITEM)]
    items += [(100 + k, f"1 2 3 4 5 6 7 {k} 9") for k in range(30)]
    texts = ["see: X 1 2 3 4, 5 6 7!", "x 1 2 3 4 5 6 8", "3.5 + 4 = 7.5, 9 - 2 = 7", "in Paris London Rome Oslo Bern Kyiv we", "Paris London Rome Oslo Riga Bern",
             "\u79c1\u306f\u6771\u4eac\u306f\u65e5\u672c\u306e\u9996\u90fd\u3067\u3059\u3068", "yes a b c d", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 12 9", "x" * 60_000, "1 " * 20_000, ITEM, None]
    rows = [*odd_rows, *((100 + k, t) for k, t in enumerate(texts)), (100, texts[0])]
    found = c.mark(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(rows)
    agree(found, items)
    by = {r.doc_id: r.item_ids for r in found}
    assert [by[100 + k] for k in range(8)] == [[1], [], [2], [3], [], [4], [], [108, 112]] and by[110] == [7]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert c.mark(docs([]), none).count() == 0
    assert [r.item_ids for r in c.mark(docs([(1, ITEM)]), none).collect()] == [[]]
