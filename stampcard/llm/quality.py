"""Quality rules as a bitmask ledger.

``measure`` reads each text once. ``ledger`` evaluates every rule once on the measurements and stores the failures as bits. A policy
is a named, versioned mask of rules, so that a verdict, another version of it, or the effect of leaving a rule out is arithmetic
on the stored bits. Null or empty texts measure zero everywhere and fail ``few_words``; repeated rows get the same bits; other columns
pass through, except those named like the ledger's own, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stampcard.llm.common import add_columns

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_exclaims"]

#: Rule and the condition of failure; the place in this list is the bit.
RULES = [
    ("few_words", "n_words < 50"),
    ("repetitive", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("capitals", "2 * n_capitals > n_letters"),
    ("exclaims", "5 * n_exclaims > n_words"),
]
BIT = {name: k for k, (name, _) in enumerate(RULES)}

#: Rules that reject, by policy and version.
POLICIES = {
    ("base", 1): ["few_words", "repetitive"],
    ("corpus", 1): ["few_words", "repetitive", "symbols", "repeated_lines", "word_length"],
    ("corpus", 2): ["few_words", "repetitive", "symbols", "repeated_lines", "word_length", "capitals", "exclaims"],
}

_SPACE = b" \t\n\r\x0b\x0c"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower()


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window found twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    place: dict[bytes, int] = {}
    code = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, n)
    grams = code[: n - window + 1]
    for k in range(1, window):
        if int(grams.max()) + 1 > (1 << 62) // len(place):
            grams = np.unique(grams, return_inverse=True)[1]
        grams = grams * len(place) + code[k : n - window + 1 + k]
    _, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : n - window + 1 + k] |= twice
    return int(covered.sum())


def _measure(text: str) -> list[int]:
    raw = text.encode()
    words = raw.split()  # bytes split on the six ASCII spaces only
    lines = [line for line in raw.split(b"\n") if line.strip()]
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    return [
        len(words), len(text) - gone(_SPACE), gone(b"#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        gone(_LETTERS), gone(_UPPER), raw.count(b"!"),
    ]


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with one long column per measurement of the whole text."""

    def make(texts: list[str]) -> list[pa.Array]:
        rows = np.array([_measure(t) for t in texts], np.int64).reshape(len(texts), len(MEASURES))
        return [pa.array(rows[:, k]) for k in range(len(MEASURES))]

    return add_columns(df, text_col, [T.StructField(m, T.LongType()) for m in MEASURES], make)


def fail_bits() -> Column:
    """All rules over the measurements as one long."""
    return sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)), F.lit(0).cast("long"))


def ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its measurements and ``fail_bits``."""
    measured = measure(df, text_col)
    return measured.select(*[f"`{c}`" for c in measured.columns if c.lower() != "fail_bits"], fail_bits().alias("fail_bits"))


def mask(rules: list[str]) -> int:
    return sum(1 << BIT[r] for r in rules)


def verdict(policy: str = "corpus", version: int = 2, bits: str = "fail_bits") -> Column:
    """True where the policy keeps the document."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy, version])).cast("long")) == 0


def ablations(entries: DataFrame, policies: dict[tuple[str, int], list[str]] | None = None) -> DataFrame:
    """For each policy and each of its rules: rejected documents, those the rule fails, those it alone rejects.

    Entries are counted by their bits first (at most ``2 ** len(RULES)`` rows), so policies cost nothing a document.
    """
    named = POLICIES if policies is None else policies
    counted = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [(p, v, mask(rules), r, 1 << BIT[r]) for (p, v), rules in named.items() for r in rules]
    every = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(v).alias("version"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for p, v, m, r, b in cases])
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0).cast("long")))
    return counted.select("fail_bits", "n", F.inline(every)).groupBy("policy", "version", "rule").agg(
        total(hit != 0).alias("n_rejected"), total(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failing"),
        total(hit == F.col("bit")).alias("n_only_this"),
    )
