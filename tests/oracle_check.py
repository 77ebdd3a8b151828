"""Compare every query with its SQL on the same tables: columns, types, row count and sorted values."""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
_TYPE_NAMES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
    "FLOAT": "float",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NaN" if value != value else repr(value + 0.0)
    return repr(value)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else a description of the first difference."""
    got_types = dict(df.dtypes)
    got = [row.asDict() for row in df.collect()]
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    want_types = {column[0]: _TYPE_NAMES.get(str(column[1]), str(column[1])) for column in result.description}
    want = [dict(zip(names, row)) for row in result.fetchall()]
    if sorted(got_types) != sorted(want_types):
        return f"columns {sorted(set(got_types) ^ set(want_types))}"
    wrong = {c: (got_types[c], want_types[c]) for c in got_types if got_types[c] != want_types[c]}
    if wrong:
        return f"types {wrong}"
    if len(got) != len(want):
        return f"rows {len(got)} against {len(want)}"
    columns = sorted(got_types)
    left = sorted(tuple(_cell(row[c]) for c in columns) for row in got)
    right = sorted(tuple(_cell(row[c]) for c in columns) for row in want)
    for one, other in zip(left, right):
        if one != other:
            where = [(c, a, b) for c, a, b in zip(columns, one, other) if a != b]
            return f"values {where[:3]} in {one}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv or list(queries):
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            message = compare(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            message = "ERROR " + str(error).split("JVM stacktrace")[0][:600]
        bad = message is not None and not message.startswith("rows only")
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - started:.1f}s {message or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
