"""Column types of one database in another, and in Spark."""

from __future__ import annotations

import re

#: PostgreSQL types in MySQL; types with a length or precision are below.
PG_TO_MYSQL = {
    "smallint": "SMALLINT", "int2": "SMALLINT", "integer": "INT", "int": "INT", "int4": "INT", "bigint": "BIGINT", "int8": "BIGINT",
    "smallserial": "SMALLINT", "serial": "INT", "bigserial": "BIGINT", "real": "FLOAT", "float4": "FLOAT", "double precision": "DOUBLE", "float8": "DOUBLE",
    "money": "DECIMAL(19,2)", "boolean": "TINYINT(1)", "bool": "TINYINT(1)", "text": "TEXT", "name": "VARCHAR(64)", "bytea": "BLOB",
    "date": "DATE", "time": "TIME", "timetz": "TIME", "timestamp": "DATETIME", "timestamptz": "DATETIME", "interval": "TEXT",
    "uuid": "CHAR(36)", "json": "JSON", "jsonb": "JSON", "xml": "LONGTEXT", "inet": "VARCHAR(45)", "cidr": "VARCHAR(45)", "macaddr": "CHAR(17)", "macaddr8": "CHAR(23)",
    "point": "TEXT", "line": "TEXT", "lseg": "TEXT", "box": "TEXT", "path": "TEXT", "polygon": "TEXT", "circle": "TEXT", "tsvector": "TEXT", "tsquery": "TEXT", "hstore": "TEXT", "oid": "BIGINT", "ltree": "TEXT",
}
#: MySQL types in PostgreSQL.
MYSQL_TO_PG = {
    "tinyint": "SMALLINT", "smallint": "SMALLINT", "mediumint": "INTEGER", "int": "INTEGER", "integer": "INTEGER", "bigint": "BIGINT",
    "float": "REAL", "double": "DOUBLE PRECISION", "date": "DATE", "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP", "time": "INTERVAL", "year": "SMALLINT",
    "tinytext": "TEXT", "text": "TEXT", "mediumtext": "TEXT", "longtext": "TEXT", "tinyblob": "BYTEA", "blob": "BYTEA", "mediumblob": "BYTEA", "longblob": "BYTEA",
    "binary": "BYTEA", "varbinary": "BYTEA", "json": "JSONB", "bool": "BOOLEAN", "boolean": "BOOLEAN", "enum": "VARCHAR(255)", "set": "VARCHAR(255)",
}
#: Oracle types in PostgreSQL.
ORACLE_TO_PG = {
    "date": "TIMESTAMP", "clob": "TEXT", "nclob": "TEXT", "long": "TEXT", "blob": "BYTEA", "raw": "BYTEA", "long raw": "BYTEA", "rowid": "VARCHAR(18)", "urowid": "VARCHAR(18)",
    "bfile": "VARCHAR(530)", "xmltype": "XML", "interval": "INTERVAL", "json": "JSONB", "boolean": "BOOLEAN", "bool": "BOOLEAN", "float": "DOUBLE PRECISION", "binary_float": "REAL", "binary_double": "DOUBLE PRECISION",
}
#: Where a type's parts stand; expressions over columns read them alike. What a list of values holds is no size.
NAME = r"^\s*(double precision|character varying|bit varying|long raw|[a-z]\w*)"
SIZE = r"^[^('\"]*\(\s*(\d+)"
SCALE = r"^[^('\"]*\(\s*\d+\s*,\s*(-?\d+)"
SUFFIX = r"\b(unsigned|with time zone|without time zone|with local time zone)\b"
ARRAY = r"\[\d*\]\s*$"


def parts(text: str) -> tuple[str, int | None, int | None, str, bool]:
    """Name, size, scale, suffix and whether an array."""
    low = text.lower().strip()
    name, size, scale, suffix = (m.group(1) if (m := re.search(p, low)) else None for p in (NAME, SIZE, SCALE, SUFFIX))
    return name or low, int(size) if size else None, int(scale) if scale else None, suffix or "", bool(re.search(ARRAY, low))


def _sized(name: str, size: int | None, scale: int | None) -> str:
    return name if size is None else f"{name}({size})" if scale is None else f"{name}({size},{scale})"


def map_type(source: str, target: str, text: str | None) -> str:
    """A column type of ``source`` (pg, mysql, oracle) in ``target`` (mysql, pg); text where nothing fits."""
    if not text or not text.strip():
        return "TEXT"
    name, size, scale, suffix, array = parts(text)
    if source == target:
        return text
    if (source, target) == ("pg", "mysql"):
        if array:
            return "TEXT"
        if name in ("numeric", "decimal"):
            return _sized("DECIMAL", size, scale)
        if name in ("varchar", "character varying"):
            return f"VARCHAR({size or 255})"
        if name in ("char", "character", "bpchar"):
            return f"CHAR({size or 1})"
        if name in ("bit varying", "varbit"):
            return f"VARCHAR({size or 255})"
        if name == "bit":
            return f"BIT({size or 1})"
        return PG_TO_MYSQL.get(name) or next((to for known, to in PG_TO_MYSQL.items() if name.startswith(known)), "TEXT")
    if (source, target) == ("mysql", "pg"):
        unsigned = suffix == "unsigned"
        if name == "tinyint" and size == 1 and not unsigned:
            return "BOOLEAN"
        if unsigned and name in ("smallint", "mediumint", "int", "integer", "bigint"):
            return {"smallint": "INTEGER", "mediumint": "INTEGER", "bigint": "NUMERIC(20,0)"}.get(name, "BIGINT")
        if name == "bit":
            return "BOOLEAN" if (size or 1) == 1 else "BYTEA"
        if name in ("decimal", "numeric"):
            return _sized("NUMERIC", size, scale)
        if name in ("char", "varchar"):
            return f"{name.upper()}({size or (1 if name == 'char' else 255)})"
        return MYSQL_TO_PG.get(name, "TEXT")
    if (source, target) == ("oracle", "pg"):
        if name == "number":
            if size is None:
                return "NUMERIC"
            if scale in (None, 0):
                return "SMALLINT" if size <= 4 else "INTEGER" if size <= 9 else "BIGINT" if size <= 18 else f"NUMERIC({size})"
            return f"NUMERIC({size},{scale})"
        if name in ("varchar2", "nvarchar2", "varchar"):
            return f"VARCHAR({size or 255})"
        if name in ("char", "nchar"):
            return f"CHAR({size or 1})"
        if name == "timestamp":
            return "TIMESTAMPTZ" if suffix.startswith("with") and suffix != "without time zone" else "TIMESTAMP"
        return ORACLE_TO_PG.get(name, "TEXT")
    raise ValueError(f"no map from {source} to {target}")


def create_table(name: str, columns: list[tuple[str, str]], source: str, extras: dict[str, str] | None = None, by: list[str] | None = None) -> str:
    """CREATE TABLE of a table of ``source`` (column, type) as a Spark table, with extra columns (column, Spark type)."""
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    cells = [f"{quoted(c)} {spark_type(source, kind).upper()}" for c, kind in columns] + [f"{quoted(c)} {kind.upper()}" for c, kind in (extras or {}).items()]
    return f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(cells)}) USING parquet" + (f" PARTITIONED BY ({', '.join(map(quoted, by))})" if by else "")


def spark_type(source: str, text: str) -> str:
    """The Spark SQL type that holds a column of ``source``."""
    name, size, scale, suffix, array = parts(text)
    if array:
        return f"array<{spark_type(source, text.replace('[]', ''))}>"
    if name in ("bool", "boolean") or (name in ("tinyint", "bit") and size == 1):
        return "boolean"
    if suffix == "unsigned" and name in ("tinyint", "smallint", "mediumint", "int", "integer", "bigint"):
        return {"tinyint": "smallint", "smallint": "int", "mediumint": "int", "bigint": "decimal(20,0)"}.get(name, "bigint")
    whole = {"tinyint": "tinyint", "smallint": "smallint", "int2": "smallint", "year": "smallint", "mediumint": "int", "int": "int", "integer": "int", "int4": "int", "serial": "int", "bigint": "bigint", "int8": "bigint", "bigserial": "bigint"}
    if name in whole:
        return whole[name]
    if name in ("float", "real", "float4", "binary_float"):
        return "float"
    if name in ("double", "double precision", "float8", "binary_double"):
        return "double"
    if name in ("decimal", "numeric", "number", "money"):
        return f"decimal({min(size, 38)},{scale or 0})" if size else "decimal(38,18)"
    if name in ("blob", "bytea", "binary", "varbinary", "raw", "bit") or name.endswith("blob"):
        return "binary"
    if name == "date" and source != "oracle":
        return "date"
    if name in ("timestamptz",) or suffix in ("with time zone", "with local time zone"):
        return "timestamp"
    if name in ("datetime", "timestamp", "date"):
        return "timestamp_ntz"
    if name == "time" and source == "mysql":
        return "interval day to second"
    if name in ("json", "jsonb"):
        return "variant"
    return "map<string,string>" if name == "hstore" else "string"
