"""Secrets by shape, and by character Markov models.

Base kinds are patterns; matches are found leftmost and without overlap, and then those too short are dropped. Beyond them, any run
of key characters that no base span touches is scored by two models of character transitions: one of random strings, one of
ordinary identifiers. Where the sum of log-likelihood ratios exceeds ``PRIOR``, the run is a secret of kind ``markov``.

A model is a table over a fixed alphabet (67 by 67 transitions, mixed with a uniform part), counted from labelled samples; nothing in
it grows with the corpus. Spans are code points, end exclusive, on whole texts. Null texts are empty; repeated rows stay repeated;
other columns pass through, except those named like the output's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampcard.llm.common import hashed_share

#: Base kinds in order (fixed values of the contract): name, pattern, group measured, least characters.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = "[A-Za-z0-9+/_=-]{20,}"
#: A random string must be this much more likely than an identifier: one in 10,000 runs is taken to be random.
PRIOR = math.log(10_000)
#: Part of each transition's probability that is spread evenly.
UNIFORM = 0.1
#: Documents that the query labels for training, about so many, chosen by a hash of their id.
TRAIN_DOCS = 2000

#: Pieces folded together; even, so that a block begins outside a match.
BLOCK = 256

_MARK, _OTHER = "\x01", "\x02"
SPAN = "struct<start:int,kind:int,end:int>"


def _matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the matches that ``keep`` accepts. Marks are set around matches; odd pieces of the cut text are the matches.

    Pieces are folded by blocks, whose starts come first, as a list that grows within one fold is copied at each step.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  (evaluates ``value`` once)

    def cut(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

    def starts(blocks: Column) -> Column:
        long = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, piece: n + F.length(piece)))
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(long, state, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")), lambda s: s["starts"])

    def fold(block: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{SPAN}>").alias("found"))

        def step(s: Column, piece: Column) -> Column:
            end = s["at"] + F.length(piece)
            span = F.struct(s["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            return F.struct(end.alias("at"), (~s["inside"]).alias("inside"), F.when(s["inside"] & keep(piece), F.array_append(s["found"], span)).otherwise(s["found"]).alias("found"))

        return F.aggregate(block, state, step, lambda s: s["found"])

    return bound(bound(pieces, cut), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), fold)))


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def plain_text(text_col: str) -> Column:
    """The text with the mark replaced by another character that no pattern holds; every position stays."""
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), _MARK, _OTHER)


def base_spans(text: Column) -> Column:
    """Spans of all base kinds, by start, then kind."""
    (_, assign, group, least), (_, access, _, access_least), (_, _, _, hex_least) = KINDS
    found = [
        F.when(F.instr(text, ":") + F.instr(text, "=") > 0, _matches(text, assign, 0, lambda m: F.length(F.regexp_extract(m, assign, group)) >= least)).otherwise(_none()),
        F.when(F.contains(text, F.lit("AKIA")), _matches(text, access, 1, lambda m: F.length(m) >= access_least)).otherwise(_none()),
        # runs are disjoint, so asking for the length at once finds the same ones as dropping short runs afterwards
        F.when(text.rlike(f"[0-9a-f]{{{hex_least}}}"), _matches(text, f"[0-9a-f]{{{hex_least},}}", 2, lambda m: F.lit(True))).otherwise(_none()),
    ]
    return F.array_sort(F.concat(*found))


def transitions(run: Column) -> Column:
    """Numbers of the character transitions of a run; characters outside the alphabet have none."""
    at = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.when((a >= 0) & (b >= 0), a * len(ALPHABET) + b))
    return F.filter(pairs, lambda p: p.isNotNull())


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition from samples ``text, random`` (boolean). Without samples of a class it is uniform."""
    n = len(ALPHABET)
    counted = samples.where("text <> '' AND random IS NOT NULL").select("random", F.explode(transitions(F.col("text"))).alias("pair")).groupBy("random", "pair").count()
    counts = {True: [0] * (n * n), False: [0] * (n * n)}
    for r in counted.collect():  # at most two rows a transition of the fixed alphabet
        counts[r.random][r.pair] = r["count"]

    def chances(c: list[int]) -> list[float]:
        rows = [sum(c[a * n : a * n + n]) for a in range(n)]
        return [UNIFORM / n + (1 - UNIFORM) * ((c[a * n + b] + 1 / n) / (rows[a] + 1)) for a in range(n) for b in range(n)]

    return [math.log(x / y) for x, y in zip(chances(counts[True]), chances(counts[False]))]


def score(run: Column, model: list[float]) -> Column:
    """Sum of the ratios over a run's transitions."""
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in model)), ",").cast("array<double>")
    return F.aggregate(transitions(run), F.lit(0.0), lambda s, p: s + F.get(table, p))


def find_secrets(df: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of start, kind (place in ``KINDS``; after them the model's), end."""
    kept = [c for c in df.columns if c == text_col or c.lower() not in ("base", "spans")]
    text = F.col("__plain")
    runs = F.when(text.rlike(RUN), _matches(text, RUN, len(KINDS), lambda run: score(run, model) > PRIOR)).otherwise(_none())
    found = df.select(*[F.col(f"`{c}`") for c in kept], plain_text(text_col).alias("__plain"))
    found = found.select(*[F.col(f"`{c}`") for c in kept], base_spans(text).alias("base"), runs.alias("__runs"))
    free = F.filter("__runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return found.select(*[F.col(f"`{c}`") for c in kept], "base", F.array_sort(F.concat("base", free)).alias("spans"))


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS) -> DataFrame:
    """``text, random`` from about ``most`` documents chosen by a hash of their id: values that base kinds name, and digests of
    those ids in hexadecimal and base 64, are random; words of letters, digits and joiners outside base spans are ordinary."""
    picked = docs.where(hashed_share(id_col, most, docs.count()))
    chosen = picked.select(F.col(id_col).alias("i"), plain_text(text_col).alias("t")).select("i", "t", base_spans(F.col("t")).alias("b"))
    named = chosen.select("t", F.explode("b").alias("s")).select(F.substring("t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("m"))
    value = named.select(F.regexp_extract("m", "([A-Za-z0-9+/_=-]+)$", 1).alias("text"), F.lit(True).alias("random"))
    digest = F.sha2(F.col("i").cast("string"), 256)
    made = picked.select(F.col(id_col).alias("i")).select(F.explode(F.array(F.substring(digest, 1, 40), F.base64(F.unhex(digest)))).alias("text"), F.lit(True).alias("random"))
    marked = F.regexp_replace("t", "|".join(p for _, p, _, _ in (KINDS[0], KINDS[1])) + "|[0-9a-f]{24,}", " ")
    words = chosen.select(F.explode(F.regexp_extract_all(marked, F.lit("[A-Za-z0-9_-]{4,}"), F.lit(0))).alias("text"), F.lit(False).alias("random"))
    return value.union(made).union(words)
