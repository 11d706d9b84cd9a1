"""A change log read by the columns its tables had at each position: versions from schema statements, joined as of a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions import lists, statements
from . import scans

#: Positions that one group of the as-of join spans.
WIDTH = 100_000


def as_of(events: DataFrame, versions: DataFrame, keys: list[str], at: str, value: str, width: int = WIDTH) -> DataFrame:
    """Adds ``value`` of the last of ``versions`` (keys, at, value) at or before each event's position ``at``; null before the first.

    Positions are cut into ranges of ``width``. The last version before each range that has events is found among the
    versions and one row a range; it enters the range as a version at its start. So a group of the join is a range of a
    key, however hot the key is, and what one task orders by key alone is a row a range.
    """
    bucket = F.floor(F.col(at) / width).cast("bigint").alias("_bucket")
    held = versions.select(*keys, bucket, F.col(at).cast("bigint").alias("_at"), F.struct(F.col(value).alias("v")).alias("_v"))
    lasts = held.groupBy(*keys, "_bucket").agg(F.max_by("_v", "_at").alias("_v")).withColumn("_kind", F.lit(1))
    ranges = events.select(*keys, bucket).distinct().withColumns({"_v": F.lit(None).cast(held.schema["_v"].dataType), "_kind": F.lit(0)})
    ahead = Window.partitionBy(*keys).orderBy("_bucket", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.unionByName(lasts).withColumn("_v", F.last("_v", ignorenulls=True).over(ahead)).where("_kind = 0 AND _v IS NOT NULL").drop("_kind")
    row = F.struct(*[F.col(c) for c in events.columns])
    empty = F.lit(None).cast(events.select(row.alias("r")).schema["r"].dataType)
    everything = (
        events.select(*keys, bucket, F.col(at).cast("bigint").alias("_at"), F.lit(2).alias("_kind"), F.lit(None).cast(held.schema["_v"].dataType).alias("_v"), row.alias("_row"))
        .unionByName(held.select(*keys, "_bucket", "_at", F.lit(1).alias("_kind"), "_v", empty.alias("_row")))
        .unionByName(carried.select(*keys, "_bucket", F.lit(None).cast("bigint").alias("_at"), F.lit(0).alias("_kind"), "_v", empty.alias("_row")))
    )
    order = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return everything.withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_kind = 2").select("_row.*", F.col("_v.v").alias(value))


def _put(columns: list[str] | None, name: str, after: str | None) -> list[str] | None:
    """``columns`` with one more: at the end where ``after`` is null, at the start where it is empty or isn't there, else behind that one."""
    if columns is None:
        return None
    lower = [c.lower() for c in columns]
    place = len(columns) if after is None else lower.index(after.lower()) + 1 if after and after.lower() in lower else 0
    return [*columns[:place], name, *columns[place:]]


def _changed(columns: list[str] | None, c: dict) -> list[str] | None:
    """Columns after one change of ``lists.column_changes``."""
    op, name = c["op"], c["name"]
    if op == "create":
        return [*(columns or ()), name]
    if op == "gone" or columns is None:
        return None
    if op == "add":
        return _put(columns, name, c["after"])
    if op == "rename":
        return [c["to"] if x.lower() == name.lower() else x for x in columns]
    without = [x for x in columns if x.lower() != name.lower()]
    return without if op == "drop" else _put(without, name, c["after"]) if op == "move" else columns


def _folded(columns: list[str] | None, row: dict) -> tuple[list[str] | None, tuple[list]]:
    """Columns after the statements of one position, and those after each of them."""
    said = []
    for changes in row["statements"]:
        columns = None if changes and changes[0]["op"] == "create" else columns
        for c in changes:
            columns = _changed(columns, c)
        said.append(columns)
    return columns, (said,)


def schema_versions(ddl: DataFrame, database: Column | None = None, width: int = WIDTH) -> DataFrame:
    """(table, seqno, columns) after each of the schema statements ``ddl`` (seqno, sql); columns is null where they aren't known.

    A CREATE begins anew; ALTERs change what was known; a table that is dropped or renamed is unknown until it is created
    again. So a table's statements are cut where it is created, dropped or renamed, which is found by ranges of positions,
    and what lies between two cuts streams past a fold that holds the columns of one position.
    """
    from .folds import ordered_fold  # which needs as_of

    touched = ddl.select("seqno", "sql", F.explode(statements.affected_tables(F.col("sql"), F.lit("") if database is None else database)).alias("table"))
    _, sub = statements.classify(F.col("sql"))
    none = F.array(F.struct(F.lit("gone").alias("op"), *[F.lit(None).cast("string").alias(c) for c in ("name", "to", "after")]))
    changes = F.when(sub == "RENAME_TABLE", none).otherwise(lists.column_changes(F.col("sql")))
    placed = touched.select("table", "seqno", changes.alias("changes")).groupBy("table", "seqno").agg(F.array_sort(F.collect_list("changes")).alias("statements"))
    # Whatever the columns were: a statement that creates the table, or leaves it unknown.
    anew = F.exists(F.get("statements", F.lit(0)), lambda c: c["op"] == "gone") | (F.get(F.get("statements", F.lit(0)), F.lit(0))["op"] == "create")
    begun = F.when(anew, F.col("seqno").cast("bigint"))
    cut = scans.before(placed, ["table"], "seqno", {"_earlier": ("max", begun)}, width).withColumn("_begun", F.coalesce(begun, "_earlier")).drop("_earlier")
    versions = ordered_fold(cut, ["table", "_begun"], ["seqno"], _folded, None, {"versions": "array<array<string>>"}, ["statements"])
    return versions.select("table", "seqno", F.explode("versions").alias("columns"))


def named_rows(log: DataFrame, versions: DataFrame, values: str = "values", width: int = WIDTH) -> DataFrame:
    """Adds image (column to value) to each row of ``log`` (table, seqno, values) by its table's columns then, and reason.

    Where the columns aren't known or the values don't fit them, image is null and reason says why: such rows are for the
    rejects, never cut or filled up to fit.
    """
    x = as_of(log, versions, ["table"], "seqno", "columns", width)
    fits = F.col("columns").isNotNull() & (F.size("columns") == F.size(values))
    reason = F.when(F.col("columns").isNull(), "no columns known").when(~fits, F.concat(F.size(values).cast("string"), F.lit(" values for "), F.size("columns").cast("string"), F.lit(" columns")))
    return x.select(*log.columns, F.when(fits, F.map_from_arrays("columns", values)).alias("image"), reason.alias("reason"))


def shadow_conversions(ddl: DataFrame, database: Column | None = None) -> DataFrame:
    """seqno, table and sql of each shadow table's CREATE among ``ddl`` (seqno, sql), as the ALTER of the table it shadows.

    The table is taken as its last CREATE before that; sql is null where there is none, where nothing changes, or where the
    change has no statement.
    """
    db, name = statements.table_of(F.col("sql"))
    full = F.concat(F.when(db == "", F.lit("") if database is None else database).otherwise(db), F.lit("."))
    x = ddl.where(F.upper(F.col("sql")).contains("CREATE")).select("seqno", "sql", full.alias("db"), name.alias("name"), statements.classify(F.col("sql"))[1].alias("sub"), statements.online_change(F.col("sql")).alias("action"))
    # Both sides of the join are read twice, statements once.
    x = written(x.where("sub = 'CREATE_TABLE'"))
    shadows = x.where("action = 'ALTER'").select("seqno", "sql", F.concat("db", F.regexp_extract("name", statements.SHADOW, 1)).alias("table"))
    originals = x.where("action = 'PASS'").select("seqno", F.concat("db", "name").alias("table"), F.col("sql").alias("original"))
    pair = as_of(shadows, originals, ["table"], "seqno", "original")
    quoted = F.concat(F.lit("`"), F.replace(F.regexp_replace("table", r"^\.", ""), F.lit("."), F.lit("`.`")), F.lit("`"))
    return pair.select("seqno", "table", lists.shadow_change(F.col("sql"), F.col("original"), quoted).alias("sql"))
