"""Column definitions of one database in another, as expressions over a catalog's table of columns: type, null, default, sequence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import ARRAY, MYSQL_TO_PG, NAME, ORACLE_TO_PG, PG_TO_MYSQL, SCALE, SIZE, SUFFIX

#: Functions of the moment, by what they are in the target.
MOMENTS = {"pg": ("now()", "clock_timestamp()", "statement_timestamp()", "transaction_timestamp()", "current_timestamp", "localtimestamp", "current_date", "current_time"), "mysql": ("now()", "current_timestamp", "current_timestamp()", "localtimestamp"), "oracle": ("current_timestamp", "systimestamp", "sysdate", "current_date", "localtimestamp")}


def _choose(rules: list[tuple[Column, Column | str]], otherwise: Column | str | None) -> Column:
    """The value of the first rule that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    first, *rest = rules
    return reduce(lambda out, rule: out.when(rule[0], lit(rule[1])), rest, F.when(first[0], lit(first[1]))).otherwise(lit(otherwise))


def mapped_type(source: str, target: str, text: Column) -> Column:
    """``types.map_type`` as an expression: a column type of ``source`` (pg, mysql, oracle) in ``target`` (mysql, pg)."""
    low = F.lower(F.trim(text))
    name, size, scale, suffix = (F.regexp_extract(low, pattern, 1) for pattern in (NAME, SIZE, SCALE, SUFFIX))
    whole = size.try_cast("int")

    def sized(to: str) -> Column:
        return F.concat(F.lit(to), _choose([(size == "", ""), (scale == "", F.concat(F.lit("("), size, F.lit(")")))], F.concat(F.lit("("), size, F.lit(","), scale, F.lit(")"))))

    def chars(to: str, least: int) -> Column:
        return F.concat(F.lit(f"{to}("), F.when(size == "", str(least)).otherwise(size), F.lit(")"))

    unsigned = suffix == "unsigned"
    if (source, target) == ("pg", "mysql"):
        rules = [
            (low.rlike(ARRAY), "TEXT"), (name.isin("numeric", "decimal"), sized("DECIMAL")), (name.isin("varchar", "character varying", "bit varying", "varbit"), chars("VARCHAR", 255)),
            (name.isin("char", "character", "bpchar"), chars("CHAR", 1)), (name == "bit", chars("BIT", 1)),
            *[(name == known, to) for known, to in PG_TO_MYSQL.items()], *[(name.startswith(known), to) for known, to in PG_TO_MYSQL.items()],
        ]
    elif (source, target) == ("mysql", "pg"):
        rules = [
            ((name == "tinyint") & (size == "1") & ~unsigned, "BOOLEAN"), (unsigned & (name == "smallint"), "INTEGER"), (unsigned & name.isin("int", "integer"), "BIGINT"), (unsigned & (name == "bigint"), "NUMERIC(20,0)"),
            (name == "bit", F.when(F.coalesce(whole, F.lit(1)) == 1, "BOOLEAN").otherwise("BYTEA")), (name.isin("decimal", "numeric"), sized("NUMERIC")), (name == "char", chars("CHAR", 1)), (name == "varchar", chars("VARCHAR", 255)),
            *[(name == known, to) for known, to in MYSQL_TO_PG.items()],
        ]
    elif (source, target) == ("oracle", "pg"):
        number = _choose([(size == "", "NUMERIC"), (~scale.isin("", "0"), sized("NUMERIC")), (whole <= 4, "SMALLINT"), (whole <= 9, "INTEGER"), (whole <= 18, "BIGINT")], F.concat(F.lit("NUMERIC("), size, F.lit(")")))
        rules = [
            (name == "number", number), (name.isin("varchar2", "nvarchar2", "varchar"), chars("VARCHAR", 255)), (name.isin("char", "nchar"), chars("CHAR", 1)),
            (name == "timestamp", F.when(suffix.isin("with time zone", "with local time zone"), "TIMESTAMPTZ").otherwise("TIMESTAMP")), *[(name == known, to) for known, to in ORACLE_TO_PG.items()],
        ]
    else:
        raise ValueError(f"no map from {source} to {target}")
    return F.when(F.coalesce(low, F.lit("")) != "", _choose(rules, "TEXT")).otherwise("TEXT")


def default_value(source: str, target: str, kind: Column, default: Column) -> Column:
    """A column's default for ``target``, whose type for it is ``kind``; null where it has none, or one that can't be said there.

    Values of sequences are left out, as are functions without a counterpart: a text that looks like a call would be
    stored as that text. Casts behind a value are dropped, booleans take the form of the column's type, and what MySQL
    allows as an expression only stands in parentheses. A bare word is a text.
    """
    said = F.trim(default)
    if source == "pg":
        said = F.regexp_replace(said, r"(?i)((?:::\s*[a-z_\"][\w\". ]*(?:\(\d+(?:,\s*\d+)?\))?(?:\[\])*)+)$", "")
        said = F.regexp_replace(said, r"^\(\s*(-?\d+(?:\.\d+)?)\s*\)$", "$1")
    low = F.lower(said)
    bit = F.regexp_extract(low, r"^b?'?([01])'?$", 1)
    true = (bit == "1") | low.isin("true", "'t'", "'true'")
    false = (bit == "0") | low.isin("false", "'f'", "'false'")
    moment = F.regexp_replace(low, r"\(\s*\d\s*\)$", "").isin(*MOMENTS[source])
    rules = [(F.coalesce(low, F.lit("")).isin("", "null"), None), (low.rlike(r"\bnextval\b"), None)]
    if target == "pg":
        rules += [((kind == "BOOLEAN") & true, "TRUE"), ((kind == "BOOLEAN") & false, "FALSE"), (low.rlike(r"^b'[01]*'$"), None), (moment, "CURRENT_TIMESTAMP")]
    else:
        moment = moment | low.rlike(r"\b(timezone|date_trunc|now)\s*\(")
        rules += [
            (moment & (kind == "DATE"), "(CURRENT_DATE)"), (moment & (kind == "TIME"), "(CURRENT_TIME)"), (moment & (kind == "DATETIME"), "CURRENT_TIMESTAMP"), (moment, "(CURRENT_TIMESTAMP)"),
            (low.isin("true", "false"), F.when(low == "true", "1").otherwise("0")), ((kind == "TINYINT(1)") & (true | false), F.when(true, "1").otherwise("0")), (low.isin("gen_random_uuid()", "uuid_generate_v4()"), "(UUID())"),
        ]
    if source == "oracle":
        rules += [(low == "user", "CURRENT_USER")]
    quoted = F.concat(F.lit("'"), F.replace(said, F.lit("'"), F.lit("''")), F.lit("'"))
    literal = low.rlike(r"^(n?'([^']|'')*'|-?\d+(\.\d+)?)$")
    value = _choose([*rules, (literal, F.regexp_replace(said, "^[nN]'", "'")), (low.rlike(r"^[\w.\"]+\s*\(.*\)$"), None)], quoted)
    if target == "mysql":
        return F.when(kind.isin("TEXT", "LONGTEXT", "BLOB", "JSON") & ~value.startswith("("), F.concat(F.lit("("), value, F.lit(")"))).otherwise(value)
    return value


def column_definition(source: str, target: str, kind: Column, nullable: Column, default: Column, auto: Column | None = None, identity: bool = False) -> Column:
    """What follows a column's name in CREATE TABLE of ``target``: type, NOT NULL, and how it is filled.

    ``auto``: whether the source numbers the column; a serial type of PostgreSQL does by itself. For MySQL that is
    AUTO_INCREMENT, for PostgreSQL an identity if asked for, else nothing, as rows bring their numbers; there is no
    default beside it. Null in ``nullable`` is nullable, and an unknown type is TEXT without anything more.
    """
    to = mapped_type(source, target, kind)
    numbered = F.coalesce(auto, F.lit(False)) if auto is not None else F.lit(False)
    if source == "pg":
        numbered = numbered | F.lower(F.trim(kind)).isin("serial", "bigserial", "smallserial")
    numbered = F.coalesce(numbered, F.lit(False))
    filled = F.lit(" AUTO_INCREMENT" if target == "mysql" else " GENERATED BY DEFAULT AS IDENTITY" if identity else "")
    value = F.coalesce(F.concat(F.lit(" DEFAULT "), default_value(source, target, to, default)), F.lit(""))
    whole = F.concat(to, F.when(F.coalesce(nullable, F.lit(True)), "").otherwise(" NOT NULL"), F.when(numbered, filled).otherwise(value))
    return F.when(kind.isNotNull(), whole).otherwise("TEXT")


def table_definitions(columns: DataFrame, source: str, target: str, identity: bool = False) -> DataFrame:
    """(table, sql): CREATE TABLE for every table of a catalog's columns.

    ``columns``: table, position, name, type, nullable, default, auto, key (place in the primary key or null). A table's
    columns meet in one row, as they are few; columns of one position stand in the order of their names.
    """
    quote = lambda name: F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')) if target == "pg" else F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))
    line = F.concat(quote(F.col("name")), F.lit(" "), column_definition(source, target, F.col("type"), F.col("nullable") & F.col("key").isNull(), F.col("default"), F.col("auto"), identity))
    whole = columns.groupBy("table").agg(
        F.array_sort(F.collect_list(F.struct("position", "name", line.alias("line")))).alias("_lines"),
        F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", quote(F.col("name")).alias("name"))))).alias("_key"),
    )
    key = F.when(F.size("_key") > 0, F.concat(F.lit(", PRIMARY KEY ("), F.array_join(F.col("_key.name"), ", "), F.lit(")"))).otherwise("")
    name = F.array_join(F.transform(F.split("table", r"\."), quote), ".")
    return whole.select("table", F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), name, F.lit(" ("), F.array_join(F.col("_lines.line"), ", "), key, F.lit(")")).alias("sql"))
