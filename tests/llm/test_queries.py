"""Registered queries against their SQL, and what each returns."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as entry
from stampcard.llm import queries
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.oracle_check import compare

TABLES = ["documents", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF_ORACLE), connect(SF_ORACLE), queries.SQL[name]) is None


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


def test_contract_columns(spark):
    wanted = {
        "op2": ["page_id", "host", "path", "rule", "verdict"],
        "op3": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op4": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op5": ["doc_id", "fingerprint", "component_id"],
        "op6": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op9": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op10": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    }
    for name, build in queries.QUERIES.items():
        columns = wanted.get(name.split("_")[0])
        if columns:
            assert build(spark, SF_SMALL).columns[: len(columns)] == columns


@pytest.mark.parametrize("name", ["op2_url_rules", "op3_secret_scan", "op7_licence_scan", "op10_chat_format"])
def test_native_plans_hold_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin|ExistingRDD", plan)
