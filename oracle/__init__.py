"""Independent SQL for every deterministic query, run by DuckDB on the same tables.

``CTES`` holds named building blocks, ``QUERIES`` the final selects. A query gets the blocks it
mentions, directly or through other blocks, as leading CTEs in dependency order.
"""

from __future__ import annotations

import re

from oracle.blocks import CTES
from oracle.queries import QUERIES

#: Blocks that several others read and that are costly to compute again.
STORED = {"fx_funnel", "life", "life3", "state", "measured"}
_WORD = re.compile(r"[a-z_][a-z0-9_]*")


def compose(select: str) -> str:
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in dict.fromkeys(_WORD.findall(sql.lower())):
            if name in CTES and name not in needed:
                visit(CTES[name])
                needed.append(name)

    visit(select)
    head = ",\n".join(f"{name} AS {'MATERIALIZED ' * (name in STORED)}(\n{CTES[name].strip()}\n)" for name in needed)
    return f"WITH {head}\n{select.strip()}" if needed else select.strip()


def all_sql() -> dict[str, str]:
    return {name: compose(select) for name, select in QUERIES.items()}
