"""Which databases and tables are in scope, and what they are called at the target."""

from __future__ import annotations

import json
from dataclasses import dataclass

#: Schemas that belong to the servers themselves.
SYSTEM_SCHEMAS = ("mysql", "information_schema", "performance_schema", "sys", "admin", "local", "config")


@dataclass(frozen=True)
class TableSpec:
    database: str
    table: str
    target_database: str
    target_table: str
    whole_database: bool = False


def parse_selection(text: str) -> list[TableSpec]:
    """A selection as JSON: {"db": []} or {"db": ["t", ...]} or {"db": {"tables", "tableMapping", "targetDb", "dbLevel"}}.

    An empty list is the whole database (table ``*``); server schemas are left out.
    """
    out = []
    for db, said in json.loads(text).items():
        if db.lower() in SYSTEM_SCHEMAS:
            continue
        detail = said if isinstance(said, dict) else {"tables": said}
        tables, names, to = detail.get("tables") or [], detail.get("tableMapping") or {}, detail.get("targetDb") or db
        if detail.get("dbLevel") or not tables:
            out.append(TableSpec(db, "*", to, "*", True))
        else:
            out += [TableSpec(db, t, to, names.get(t, t)) for t in tables]
    return out
