"""URL rules by hash prefixes.

A rule is a host and a path prefix. It fits the host and all its subdomains if the URL's path starts with the rule's path. Each URL is
expanded into host suffix + path prefix for the label counts and path lengths that occur among the rules, which bounds the
expansion by the rules' shapes, not by the URL. Expressions meet the rules on the first four bytes of their SHA-256; the
full digest confirms. The longest rule wins, then the longer host, then block before allow.

Equal URLs are judged once, so copies of one URL, and its busy host, are one row from the start. Null URLs, or ones without ``://``,
have empty host and path and no rule. Repeated rows stay repeated; an empty rule list leaves the default verdict everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_BYTES = 4


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://``, and the path after it."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def _short(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, PREFIX_BYTES)), 16, 10).cast("long")


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their expression, digest and hash prefix."""
    rule = F.concat(F.translate("host", UPPER, LOWER), F.col("path"))
    known = rules.where("host IS NOT NULL AND host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
    return known.select(rule.alias("rule"), F.length("host").alias("host_length"), "verdict", _digest(rule).alias("rule_digest")).withColumn("short", _short(F.col("rule_digest")))


def shapes(rules: DataFrame) -> tuple[list[int], list[int]]:
    """Label counts of the rules' hosts and lengths of their paths: as many numbers as there are different ones."""
    row = rules.agg(
        F.array_sort(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths")
    ).first()
    return list(row.labels), list(row.lengths)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``; columns of these names are replaced."""
    labels, lengths = shapes(rules)
    host, path = host_and_path("u")
    urls = pages.select(F.col(url_col).alias("u")).where("u IS NOT NULL").distinct().select("u", host.alias("h"), path.alias("p"))
    parts = F.split("h", r"\.")
    numbers = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<int>")
    suffixes = F.transform(F.filter(numbers(labels), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(numbers(lengths), lambda n: n <= F.length("p")), lambda n: F.substring(F.col("p"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda x: F.concat(s, x))))
    expanded = urls.select("u", F.explode(F.array_distinct(expressions)).alias("e")).select("u", _digest(F.col("e")).alias("digest"))
    met = expanded.withColumn("short", _short(F.col("digest"))).join(compile_rules(rules), "short").where("digest = rule_digest")
    rank = F.struct(F.length("rule").alias("size"), "host_length", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")
    best = met.groupBy("u").agg(F.max(rank).alias("best")).select(F.col("u").alias("__u"), F.col("best.rule").alias("__rule"), F.col("best.verdict").alias("__verdict"))
    kept = [c for c in pages.columns if c == url_col or c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path("__url")
    joined = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(url_col).alias("__url")).join(best, F.col("__url") == F.col("__u"), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"), F.col("__rule").alias("rule"),
        F.coalesce("__verdict", F.lit(default)).alias("verdict"),
    )
