"""Maps query names to functions and SQL."""

from __future__ import annotations

from quire.plans import table_queries, text_queries

flagship = text_queries.flagship
ALL = text_queries.QUERIES | table_queries.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
