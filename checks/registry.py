"""All registered queries."""

from __future__ import annotations

from checks import market, orders, reads, sources, storage, text, topics, trends

MODULES = (trends, market, orders, text, topics, reads, sources, storage)


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
