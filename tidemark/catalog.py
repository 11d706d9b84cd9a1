"""Queries of the library's own operators and their SQL."""

from __future__ import annotations

from .plans import changes, checks, flows, observe, routes, rows, schema, versions

PARTS = (rows, routes, changes, checks, observe, schema, versions, flows)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
