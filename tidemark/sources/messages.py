"""Change messages as JSON text (of Kafka, or of files) parsed into a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.changelog import overlay

#: Kinds of change and the one-letter operations of a log.
OPERATIONS = {"INSERT": "c", "UPDATE": "u", "DELETE": "d"}
#: Physical milliseconds stand above the logical part of a commit time.
TSO_SHIFT = 18
_CANAL = """type string, isDdl boolean, database string, `table` string, pkNames array<string>, es long, ts long, sql string,
  data array<map<string,string>>, old array<map<string,string>>, _tidb struct<commitTs: long, watermarkTs: long>"""
_OPLOG = "op string, ns string, ts struct<t: long, i: long>, o string, o2 string"


def operation(kind: Column) -> Column:
    """c, u or d of a kind of change in any case; null of others, as commits, rotations and heartbeats."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv]), F.upper(kind))


def parse_canal(messages: DataFrame, value: str = "value") -> DataFrame:
    """Adds m, the message, and kind: ROW, DDL, HEARTBEAT, OTHER, or BROKEN where the text is no such message."""
    x = messages.withColumn("m", F.from_json(value, _CANAL))
    kind = (
        F.when(F.col("m").isNull() | F.col("m.type").isNull(), "BROKEN").when(F.upper("m.type") == "TIDB_WATERMARK", "HEARTBEAT").when(F.col("m.isDdl"), "DDL")
        .when(operation(F.col("m.type")).isNotNull(), "ROW").otherwise("OTHER")
    )
    return x.withColumn("kind", kind)


def canal_time(m: str = "m") -> Column:
    """Milliseconds of the commit, else of the event; null where neither is told."""
    commit = F.coalesce(F.col(f"{m}._tidb.commitTs"), F.col(f"{m}._tidb.watermarkTs"))
    return F.when(commit > 0, F.shiftright(commit, TSO_SHIFT)).otherwise(F.col(f"{m}.es"))


def canal_changes(parsed: DataFrame, databases: list[str] | None = None) -> DataFrame:
    """The row messages of ``parse_canal`` as changes: database, table, op, source_ts, row number, after and before images.

    ``old`` tells only what changed: the image before is the one after with that put over it. Deletes have no image
    after, inserts none before.
    """
    x = parsed.where("kind = 'ROW'")
    if databases is not None:
        x = x.where(F.col("m.database").isin(databases))
    rest = [c for c in parsed.columns if c not in ("m", "kind")]
    x = x.select(*rest, "m", F.posexplode(F.arrays_zip(F.col("m.data").alias("data"), F.coalesce("m.old", F.array().cast("array<map<string,string>>")).alias("old"))).alias("row", "_r"))
    op, image = operation(F.col("m.type")), F.col("_r.data")
    before = F.when(op == "d", image).when(op == "u", F.when(F.col("_r.old").isNull(), image).otherwise(overlay(image, F.col("_r.old"))))
    return x.select(*rest, F.col("m.database").alias("database"), F.col("m.table").alias("table"), op.alias("op"), canal_time().alias("source_ts"), "row", F.when(op != "d", image).alias("after"), before.alias("before"))


def parse_oplog(entries: DataFrame, value: str = "value") -> DataFrame:
    """Entries of an oplog as changes: database, collection, op, position "seconds:number", doc and key as JSON text.

    No-operations and text that is no entry are left out; commands have op x.
    """
    rest = [c for c in entries.columns if c != value]
    x = entries.select(*rest, F.from_json(value, _OPLOG).alias("e")).where("e.op IS NOT NULL AND e.op <> 'n'")
    op = F.element_at(F.create_map(*[F.lit(c) for c in "icuudd"]), F.col("e.op"))
    db = F.substring_index("e.ns", ".", 1)
    key = F.coalesce(F.get_json_object(F.coalesce("e.o2", "e.o"), "$._id.$oid"), F.get_json_object(F.coalesce("e.o2", "e.o"), "$._id"))
    return x.select(*rest, db.alias("database"), F.expr("substring(e.ns, instr(e.ns, '.') + 1)").alias("collection"), F.coalesce(op, F.lit("x")).alias("op"), F.concat_ws(":", "e.ts.t", "e.ts.i").alias("position"), F.col("e.o").alias("doc"), key.alias("key"))
