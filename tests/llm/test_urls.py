"""URL verdicts against a plain reading of the rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from stampcard.llm import queries, urls

SCHEMA = "page_id long, url string"


def plain(url, rules, default="allow"):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host, path = re.match("([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else (0, 0, 0, None, default)
    return host, path, best[3], best[4]


URLS = [
    "http://example.org/es/x", "https://A.B.Example.ORG/en/123?q=/es/", "http://example.org/en/2", "http://example.org", "http://org/", "http://xorg/", "ftp://x.com/fr/",
    "x.com/de/", "http://x.com/de/#a", "http://x.com/de", "http://a.com/fr/b://c.org/", "", None, "http://", "http://..org/", "http://x.org:80/", "http://é.org/é", "http://x.com/DE/",
    "http://" + "a." * 3000 + "com/de/" + "p" * 5000, "http://x.com/de/", "http://x.com/de/", "http://x.com?/fr/",
]


def check(spark, rules):
    pages = spark.createDataFrame(list(enumerate(URLS)), SCHEMA).withColumn("host", F.lit(1)).withColumn("digest", F.lit(2))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, table).collect()}
    assert found == {i: plain(u, [(h.lower(), p, v) for h, p, v in rules if h]) for i, u in enumerate(URLS)}


def test_contract_rules(spark):
    check(spark, queries.URL_RULES)


def test_ties_repeats_and_odd_rules(spark):
    check(spark, [("b.example.org", "/e", "allow"), ("example.org", "/en/", "block"), ("ORG", "/", "block"), ("org", "/", "allow"), ("", "/", "block"), ("com", "", "block")])


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    rows = urls.judge(spark.createDataFrame(list(enumerate(URLS)), SCHEMA), none, default="block").collect()
    assert len(rows) == len(URLS) and {(r.rule, r.verdict) for r in rows} == {(None, "block")}
    assert urls.judge(spark.createDataFrame([], SCHEMA), none).count() == 0
