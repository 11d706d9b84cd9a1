"""Schema statements rewritten for another server, other names, or a merged or split table: column expressions on their text.

What stands in string literals is never touched. A statement that has no translation becomes null: it is for a person.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexer import let
from .statements import bare
from .types import MYSQL_TO_PG, PG_TO_MYSQL

_PIECES = r"('(?:[^'\\]++|''|\\[\s\S])*+'|[^']++|')"
#: A type stands behind a name, which isn't itself the word that announces one.
_BEHIND = r"(?i)(?<=[\w\"`]\s)(?<!\b(?:add|column|key|table|on)\s)"
_SIZED = {"datetime", "timestamp", "time"}
TAG_LENGTH = 64


def outside_literals(sql: Column, rewrite: Callable[[Column], Column]) -> Column:
    """The statement with everything but its string literals rewritten."""
    pieces = F.regexp_extract_all(sql, F.lit(_PIECES), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("'"), p).otherwise(rewrite(p))), "")


def _chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


_MYSQL_WHOLE = [
    (r"(?i)\s+comment\s*=?\s*'(?:[^'\\]|''|\\.)*'", ""), (r"(?i)\b(enum|set)\s*\(\s*'[^)]*'\s*\)", "VARCHAR(255)"),
]
_MYSQL_RULES = [
    (r"`([^`]*)`", '"$1"'),
    (r"(?i)\bbigint(\s*\(\d+\))?(\s+unsigned)?((?:\s+not\s+null)?)\s+auto_increment\b", "BIGSERIAL$3"), (r"(?i)\b(?:medium|small)?int(?:eger)?(\s*\(\d+\))?(\s+unsigned)?((?:\s+not\s+null)?)\s+auto_increment\b", "SERIAL$3"),
    (r"(?i)\s+(default\s+)?(engine|charset|character\s+set|collate|row_format|auto_increment)\s*=\s*\w+", ""), (r"(?i)\s+(?:character\s+set|collate)\s+\w+", ""), (r"(?i)\s+auto_increment\b", ""),
    (r"(?i)\s+on\s+update\s+current_timestamp(\(\d*\))?", ""),
    (_BEHIND + r"tinyint\s*\(\s*1\s*\)(?!\s+unsigned)", "BOOLEAN"), (_BEHIND + r"bigint(\s*\(\d+\))?\s+unsigned", "NUMERIC(20,0)"), (_BEHIND + r"(?:medium|)int(?:eger)?(\s*\(\d+\))?\s+unsigned", "BIGINT"),
    (_BEHIND + r"smallint(\s*\(\d+\))?\s+unsigned", "INTEGER"), (_BEHIND + r"tinyint(\s*\(\d+\))?\s+unsigned", "SMALLINT"), (_BEHIND + r"bit\s*(?:\(\s*1\s*\)|(?!\s*\())", "BOOLEAN"), (_BEHIND + r"bit\s*\(\d+\)", "BYTEA"),
    (_BEHIND + r"decimal\b", "NUMERIC"),
    *[(_BEHIND + rf"{name}\b" + ("" if name in _SIZED else r"(\s*\(\d+(?:,\d+)?\))?"), to) for name, to in MYSQL_TO_PG.items() if name not in ("enum", "set") and name.upper() != to],
    (r"(?i)^\s*rename\s+table\s+(\S+)\s+to\s+", "ALTER TABLE $1 RENAME TO "), (r"(?i)\bmodify\s+(?:column\s+)?(\"[^\"]+\"|\w+)\s+", "ALTER COLUMN $1 TYPE "),
    (r"(?i)\bchange\s+(?:column\s+)?(\"[^\"]+\"|\w+)\s+\1\s+", "ALTER COLUMN $1 TYPE "), (r"(?i)\s+using\s+btree\b", ""), (r"(?i)^(\s*drop\s+index\s+\S+)\s+on\s+\S+", "$1"),
]
_PG_RULES = [
    (r'"([^"]*)"', "`$1`"), (r"(?i)\bbigserial\b", "BIGINT AUTO_INCREMENT"), (r"(?i)\bserial\b", "INT AUTO_INCREMENT"), (_BEHIND + r"\w+(?:\s+\w+)?\s*\[\]", "TEXT"),
    (_BEHIND + r"(?:timestamp|time)(\s*\(\d+\))?\s+with(?:out)?\s+time\s+zone", "DATETIME$1"), (_BEHIND + r"character\s+varying\b", "VARCHAR"), (_BEHIND + r"numeric\b", "DECIMAL"),
    *[(_BEHIND + rf"{name}\b", to) for name, to in PG_TO_MYSQL.items() if name.upper() != to and name not in ("serial", "bigserial", "smallserial")],
    (r"(?i)\balter\s+column\s+(`[^`]+`|\w+)\s+type\s+", "MODIFY COLUMN $1 "), (r"(?i)\s+using\s+btree\b", ""),
]
_KNOWN = r"(?i)^(create\s+(temporary\s+)?table|alter\s+table|drop\s+table|truncate|create\s+(unique\s+)?index|drop\s+index|rename\s+table)\b"


def translated(sql: Column, source: str, target: str) -> Column:
    """A schema statement of ``source`` (mysql, pg) for ``target``; null where it is of a kind, or has a part, without translation."""
    if source == target:
        return bare(F.trim(sql))
    return let(bare(F.trim(sql)), lambda text: _translated(text, source, target))


def _translated(text: Column, source: str, target: str) -> Column:
    if (source, target) == ("mysql", "pg"):
        out = outside_literals(_chain(text, _MYSQL_WHOLE), lambda p: _chain(p, _MYSQL_RULES))
        # An index over the beginnings of a column is over the column.
        out = let(out, lambda o: F.when(text.rlike(r"(?i)^create\s+(unique\s+)?index"), F.regexp_replace(o, r"([\w\"])\s*\(\d+\)", "$1")).otherwise(o))
        whole = ~text.rlike(r"(?i)\bchange\s+(column\s+)?+(\S+)\s+(?!\2\s)")
    elif (source, target) == ("pg", "mysql"):
        out = outside_literals(text, lambda p: _chain(p, _PG_RULES))
        out = let(out, lambda o: F.when(text.rlike(r"(?i)^create\s+(temporary\s+)?table"), F.regexp_replace(o, r"\)\s*;?\s*$", ") ENGINE=InnoDB")).otherwise(o))
        whole = F.lit(True)
    else:
        raise ValueError(f"no translation from {source} to {target}")
    return F.when(text.rlike(_KNOWN) & whole, F.trim(out))


def renamed(sql: Column, names: dict[str, str]) -> Column:
    """Tables under other names, where a table's name can stand: ``db.table`` or ``table`` to what takes its place.

    The longest name that fits is taken, in any case and with or without quotes. Columns' qualifiers follow their table,
    unless the statement gives its name to another as an alias. Other columns and literals stay.
    """
    quote = lambda name: r"\s*\.\s*".join(rf"[`\"]?{re.escape(part)}[`\"]?" for part in name.split("."))
    keyword = r"(?:table|into|from|update|join|references|exists|to|truncate)"
    before = rf"(?i)(\b(?:{keyword}|on)\s+)"
    mark = lambda to: "\u0001" + to.replace("$", r"\$") + "\u0001"
    longest = sorted(names.items(), key=lambda x: -len(x[0]))
    # Names already put stand in marks, so that no rule renames them again.
    rules = [(before + quote(name) + r"(?![\w$`\".])", "$1" + mark(to)) for name, to in longest]
    short = {name.rsplit(".", 1)[1]: to.rsplit(".", 1)[-1] for name, to in longest if "." in name and name.rsplit(".", 1)[1] not in names}
    out = outside_literals(sql, lambda p: _chain(p, rules))

    def qualified(name: str, to: str) -> Callable[[Column], Column]:
        rule = (rf"(?i)(?<![\w$`\".\u0001])(?<!\b{keyword}\s){quote(name)}(?=\s*\.\s*[\w`\"*])", mark(to))
        alias = rf"(?i)\bas\s+{quote(name)}(?![\w$`\"])"
        return lambda text: F.when(text.rlike(alias), text).otherwise(outside_literals(text, lambda p: _chain(p, [rule])))

    # Each text is computed once: written out, every name would triple all that stands before it.
    for name, to in [*longest, *short.items()]:
        out = let(out, qualified(name, to))
    return F.translate(out, "\u0001", "")


def _quoted(name: str, target: str) -> str:
    return f'"{name}"' if target == "pg" else f"`{name}`"


_KEY = r"(?i)(primary\s+key\s*\((?:[^()]|\(\d+\))*)\)"


def merged_table(sql: Column, tags: list[str], target: str = "mysql") -> Column:
    """CREATE TABLE of one of the tables that merge into one: with the tag columns, which are part of the key; null without a key."""
    wide = ", ".join(f"{_quoted(t, target)} VARCHAR({TAG_LENGTH}) NOT NULL DEFAULT ''" for t in tags)
    keyed = F.regexp_replace(sql, _KEY, "$1, " + ", ".join(_quoted(t, target) for t in tags) + ")")
    # The definitions end at the last parenthesis that begins a line, else at the last one.
    end = F.when(keyed.contains("\n)"), F.regexp_replace(keyed, r"(?s)^(.*)\n\)", "$1, " + wide + "\n)")).otherwise(F.regexp_replace(keyed, r"(?s)^(.*)\)", "$1, " + wide + ")"))
    return F.when(sql.rlike(_KEY), end)


def split_table(sql: Column, name: Column) -> Column:
    """CREATE TABLE of one shard: under its own name, its keys given from outside."""
    plain = F.regexp_replace(sql, r"(?i)\s+auto_increment\b(\s*=\s*\d+)?", "")
    head = F.regexp_extract(plain, r"(?is)^(create\s+table\s+(?:if\s+not\s+exists\s+)?)", 1)
    return F.concat(head, name, F.regexp_replace(plain, r"(?is)^create\s+table\s+(?:if\s+not\s+exists\s+)?(?:[`\"]?[\w$]+[`\"]?\s*\.\s*)?[`\"]?[\w$]+[`\"]?", ""))
