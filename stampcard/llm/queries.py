"""The registered queries of the text operators, with production settings, and SQL where SQL can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stampcard.llm import bpe, chat, contamination, licences, lines, packing, quality, records, secrets, simhash, structure, trie, urls
from stampcard.llm.common import table
from stampcard.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return keep


@query("op4_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *rules, bytes_col="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_simhash_groups")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_QUALITY_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS kept_lines
  FROM documents
),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM texts WHERE len(words) > 3)
),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
measured AS (
  SELECT t.doc_id, len(words) AS n_words, CAST(length(list_aggregate(words, 'string_agg', '')) AS BIGINT) AS chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(kept_lines) - len(list_distinct(kept_lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, len(kept_lines) AS n_lines, length(regexp_replace(body, '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(body, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(body, '[^!]', '', 'g')) AS n_exclaims
  FROM texts t LEFT JOIN covered c ON c.doc_id = t.doc_id
),
ruled AS (
  SELECT *, coalesce(chars, 0) AS word_chars, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (10 * n_dup_lines > 3 * n_lines)::INT + 16 * (coalesce(chars, 0) < 2 * n_words OR coalesce(chars, 0) > 20 * n_words)::INT
    + 32 * (2 * n_capitals > n_letters)::INT + 64 * (5 * n_exclaims > n_words)::INT AS BIGINT) AS fail_bits
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM ruled
"""


@query("op6_quality_ledger", _QUALITY_SQL)
def quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.verdict("base", 1)).alias("base_failed"),
        quality.verdict().alias("kept"), "fail_bits",
    )


@query("op9_token_records")
def token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "records")
    index = records.write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    read = records.read_records(index, folder, packed=True)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op8_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licence_sql() -> str:
    """Licences by the same table in other words: cuts doubled, so that each sentence has its own at both ends; sentences as rows."""
    known = licences.usual_sentences()
    marked = "translate(lower(coalesce(text, '')), chr(1) || chr(2), '  ')"
    for pattern, to in licences.STEPS:
        marked = f"regexp_replace({marked}, {_quoted(pattern.replace('(?dm)', '(?m)'))}, {_quoted(re.sub('[$]([0-9])', lambda m: chr(92) + m[1], to))}, 'g')"
    shapes = licences.known_pattern(known, r"\n\n", r"\x01\x01")
    slots = " ".join(f"WHEN regexp_matches(norm, {_quoted(shape)}) THEN {_quoted(name)}" for name, shape in licences.slot_patterns(known))
    plain = ", ".join(f"({_quoted(name)}, {_quoted(licences.normal_sentence(x))})" for name, x in known.items() if "{}" not in x)
    rules = ", ".join(f"({_quoted(name)}, {_quoted('|' + '|'.join(ids) + '|')})" for name, ids in licences.usual_rules())
    guard = "'|bsd-binary|list-item'"
    return f"""
WITH known(name, sentence) AS (VALUES {plain}),
rules(licence, ids) AS (VALUES {rules}),
marked AS (
  SELECT doc_id, chr(1) || trim({marked}) || chr(1) AS line FROM documents
  WHERE regexp_matches(lower(coalesce(text, '')), {_quoted('|'.join(licences.triggers(known)))})
),
twice AS (SELECT doc_id, replace(replace(line, chr(10), chr(10) || chr(10)), chr(1), chr(1) || chr(1)) AS line FROM marked),
taken AS (SELECT doc_id, regexp_extract_all(line, {_quoted(f"(?:[{chr(92)}n{chr(92)}x01]|{chr(92)}x02{chr(92)}x01{chr(92)}x01)(?:{shapes})[{chr(92)}n{chr(92)}x01]|{chr(92)}x02")}) AS found FROM twice),
cut AS (SELECT doc_id, unnest(found) AS raw, generate_subscripts(found, 1) AS place FROM taken),
cleaned AS (SELECT doc_id, place, trim(regexp_replace(raw, '[ {chr(92)}n{chr(92)}x01{chr(92)}x02]+', ' ', 'g')) AS norm FROM cut),
tags AS (
  SELECT doc_id, place, string_split(CASE WHEN starts_with(norm, 'spdx license identifier ')
    THEN regexp_replace(norm, {_quoted(licences.tag_chain(known))}, chr(1) || 'spdx license identifier {chr(92)}1', 'g') ELSE norm END, chr(1)) AS norms FROM cleaned
),
placed AS (SELECT doc_id, 1000 * place + generate_subscripts(norms, 1) AS place, unnest(norms) AS norm FROM tags),
named AS (
  SELECT doc_id, place, CASE WHEN norm = '' THEN 'list-item' WHEN regexp_matches(norm, '^copyright [0-9c]') THEN 'copyright' WHEN name IS NOT NULL THEN name {slots} END AS id
  FROM placed LEFT JOIN known ON sentence = norm
),
lined AS (SELECT doc_id, '|' || string_agg(id, '|' ORDER BY place) AS ids FROM named WHERE id IS NOT NULL GROUP BY doc_id),
joined AS (
  SELECT doc_id, substr(replace(replace(replace(ids, {guard}, '|bsd-binary|+'), '|list-item', ''), '|+', '|list-item'), 2) AS ids FROM lined
)
SELECT d.doc_id, coalesce(j.ids, '') AS sentence_ids,
  coalesce((SELECT string_agg(DISTINCT licence, ',' ORDER BY licence) FROM rules r WHERE contains('|' || j.ids || '|', r.ids)
    AND NOT EXISTS (SELECT 1 FROM rules o WHERE o.ids <> r.ids AND contains(o.ids, r.ids) AND contains('|' || j.ids || '|', o.ids))), '') AS licences
FROM documents d LEFT JOIN joined j ON j.doc_id = d.doc_id
"""


@query("op7_licence_scan", _licence_sql())
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.recognise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentence_ids", "|").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


#: The rules of the contract: host, path, verdict (fixed values).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_URL_SQL = """
WITH rules(h, p, v) AS (VALUES {rules}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
known AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
)
SELECT page_id, host, path,
       (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
       coalesce((SELECT max_by(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM known
""".format(rules=", ".join(str(r) for r in URL_RULES))


@query("op2_url_rules", _URL_SQL)
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS t(host, path, verdict)")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


#: A conversation added to the table: control strings as content.
EXTRA_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
marked AS (
  SELECT *, length(body) + (length(body) - length(replace(body, chr(92), '')))
         + len(regexp_extract_all(body, '<\||</?s>|\[/?INST\]|<</?SYS>>')) AS written FROM turns
),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn, role, body) AS everything,
         string_agg(CASE WHEN role = 'assistant' THEN body ELSE '' END, '' ORDER BY turn, role, body) AS learned,
         sum(written + length(role) + length('<|turn|><|body|><|end|>')) AS formatted_chars
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(everything) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""


@query("op10_chat_format", _CHAT_SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(f"SELECT CAST(c AS LONG), CAST(t AS LONG), r, x FROM VALUES {', '.join(map(str, EXTRA_CHAT))} AS t(c, t, r, x)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    formatted = chat.format_chats(rows)
    read = formatted.select("conv_id", "formatted", chat.parse_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    lines_ = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines_, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op3_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train(secrets.labelled_samples(docs)))
    names = F.array(*[F.lit(name) for name, *_ in secrets.KINDS], F.lit("markov"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"),
    )


@query("op1_template_decontamination")
def template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.size("item_ids").cast("long").alias("n_items"), "item_ids")


@query("op13_structure_repair")
def structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = structure.damage(table(spark, sf_dir, "conversations"))
    return structure.audit_conversations(damaged, F.col("gone"))


_TRIE_SQL = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY n) AS t
  FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(n))
),
told AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'body': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
picked AS (
  SELECT conv_id, turns, CAST(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS INT) AS h
  FROM told, crc_table
),
built AS (
  SELECT p.conv_id, list_concat(coalesce(b.turns, [])[1:h], p.turns[h + 1:]) AS turns FROM picked p LEFT JOIN told b ON b.conv_id = p.conv_id - p.conv_id % 20
),
prefixes AS (
  SELECT conv_id, turns[1:d] AS prefix, d AS depth, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)
),
nodes AS (
  SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ended
  FROM prefixes GROUP BY prefix
),
kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sized AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children,
         CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.prefix[depth].body, '{word}')) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN kids k ON k.prefix = n.prefix
),
above AS (
  SELECT prefix[1:k] AS prefix, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT prefix, saved, n_children, unnest(range(0, depth + 1)) AS k FROM sized) GROUP BY 1
)
SELECT s.conv_id, CAST(s.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens,
       sha256(s.ended) AS ends_sha256
FROM sized s JOIN above a ON a.prefix = s.prefix LEFT JOIN nodes p ON s.depth > 0 AND p.depth = s.depth - 1 AND p.prefix = s.prefix[1:s.depth - 1]
""".format(word=trie.WORD)


@query("op11_prefix_trie", _TRIE_SQL)
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(trie.sequences(table(spark, sf_dir, "conversations"))))


@query("op12_vector_packing")
def vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, packed=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("example_tokens").alias("doc_tokens"), "sequence_id", "offset")
