"""Change logs: ordered inserts, updates and deletes, their transactions, and the state they lead to.

A log has seqno (the total order), op (c, u or d) and key columns. Folds are maxima by seqno, so that they combine
before the shuffle and a hot key costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_latest(log: DataFrame, pk: list[str], update_missing: str = "upsert") -> DataFrame:
    """The rows that are left when the log is applied; updates carry whole rows.

    ``update_missing``: whether an update of a missing row inserts it (upsert) or does nothing (ignore).
    """
    rest = [c for c in log.columns if c not in pk]
    if update_missing == "upsert":
        last = log.groupBy(*pk).agg(F.max_by(F.struct(*rest), "seqno").alias("_row"))
        return last.where("_row.op <> 'd'").select(*pk, "_row.*")
    # An update counts where an insert stands between it and the last delete before it: so the last insert after the
    # last delete decides whether there is a row, and the last write after that insert what it holds.
    last = log.groupBy(*pk).agg(F.coalesce(F.max(F.when(F.col("op") == "d", F.col("seqno"))), F.lit(-1)).alias("_gone"))
    alive = log.join(last, pk).where("op <> 'd' AND seqno > _gone")
    found = alive.groupBy(*pk).agg(F.min(F.when(F.col("op") == "c", F.col("seqno"))).alias("_born"), F.max_by(F.struct(*rest), "seqno").alias("_row"))
    return found.where("_born IS NOT NULL").select(*pk, "_row.*")


def apply_ignore(log: DataFrame, pk: list[str]) -> DataFrame:
    """Inserts that don't overwrite: of each key the first insert since its last delete, if any; updates aside."""
    rest = [c for c in log.columns if c not in pk]
    last = log.groupBy(*pk).agg(F.coalesce(F.max(F.when(F.col("op") == "d", F.col("seqno"))), F.lit(-1)).alias("_gone"))
    alive = log.where("op = 'c'").join(last, pk).where("seqno > _gone")
    return alive.groupBy(*pk).agg(F.min_by(F.struct(*rest), "seqno").alias("_row")).select(*pk, "_row.*")


def upsert(target: DataFrame, source: DataFrame, pk: list[str]) -> DataFrame:
    """``target`` with the rows of ``source`` put over those of their keys."""
    return target.join(source, pk, "left_anti").unionByName(source)


def split_key_changes(log: DataFrame, old: str, new: str) -> DataFrame:
    """Updates that change the key as a delete of the old and an insert of the new one, in that order at one seqno."""
    moved = (F.col("op") == "u") & F.col(old).isNotNull() & ~F.col(old).eqNullSafe(F.col(new))
    part = lambda op, key, n: F.struct(F.lit(op).alias("op"), key.alias("key"), F.lit(n).alias("part"))
    whole = F.struct(F.col("op"), F.when(F.col("op") == "d", F.coalesce(old, new)).otherwise(F.col(new)).alias("key"), F.lit(0).alias("part"))
    parts = F.explode(F.when(moved, F.array(part("d", F.col(old), 0), part("c", F.col(new), 1))).otherwise(F.array(whole)))
    rest = [c for c in log.columns if c not in ("op", old, new)]
    return log.withColumn("_part", parts).select(*rest, "_part.*")


def filter_transition(op: Column, before_out: Column, after_out: Column) -> Column:
    """What a change becomes where a row filter excludes its image before or after; null: nothing."""
    return (
        F.when(op == "u", F.when(~before_out & after_out, F.lit("d")).when(before_out & ~after_out, F.lit("c")).when(before_out & after_out, F.lit(None)).otherwise(F.lit("u")))
        .when(op == "d", F.when(~before_out, F.lit("d"))).otherwise(F.when(~after_out, F.lit("c")))
    )


def explode_rows(events: DataFrame, after: str, before: str, columns: list[str]) -> DataFrame:
    """Events of many rows as events of one: seqno + i, event_id with its number, and named values.

    Rows with another number of values than there are columns keep their raw values and have no map.
    """
    size = len(columns)
    as_map = lambda v: F.when(F.size(v) == size, F.map_from_arrays(F.array(*map(F.lit, columns)), v))
    x = events.select("*", F.posexplode(F.arrays_zip(F.col(after).alias("a"), F.col(before).alias("b"))).alias("_i", "_row"))
    rest = [c for c in events.columns if c not in ("seqno", "event_id", after, before)]
    return x.select(*rest, (F.col("seqno") + F.col("_i")).alias("seqno"), F.concat_ws("_", "event_id", "_i").alias("event_id"), as_map(F.col("_row.a")).alias("after"), as_map(F.col("_row.b")).alias("before"))


def overlay(under: Column, over: Column) -> Column:
    """Entries of ``over`` put over those of ``under``: the image that a partial one completes."""
    return F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(over, k)), over)


def message_key(db: str, table: str, pk: list[Column], fallback: Column) -> Column:
    """``db.table.`` and the key's values joined by underscores, a null among them as ``\\\\N``; the fallback where all are null."""
    key = F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in pk])
    return F.when(F.coalesce(*[c.cast("string") for c in pk]).isNotNull() & (key != ""), F.concat(F.lit(f"{db}.{table}."), key)).otherwise(fallback.cast("string"))


def topic(strategy: str, prefix: str, task: str, db: Column, table: Column) -> Column:
    """TABLE, TASK or GLOBAL."""
    return {"TABLE": F.concat_ws(".", F.lit(prefix), F.lit(task), db, table), "TASK": F.lit(f"{prefix}.{task}"), "GLOBAL": F.lit(f"{prefix}.events")}[strategy]


def envelope(before: Column, after: Column, source: Column, op: Column, ts_ms: Column, transaction: Column) -> Column:
    """The JSON message of a change; delete messages have no image after, inserts none before."""
    payload = F.struct(
        F.when(op != "c", before).alias("before"), F.when(op != "d", after).alias("after"), source.alias("source"), op.alias("op"), ts_ms.alias("ts_ms"), transaction.alias("transaction")
    )
    return F.to_json(F.struct(payload.alias("payload")), {"ignoreNullFields": "false"})


def simple_envelope(op: Column, db: Column, table: Column, data: Column, ts_ms: Column) -> Column:
    return F.to_json(F.struct(op.alias("op"), db.alias("db"), table.alias("table"), data.alias("data"), ts_ms.alias("ts_ms")))


def tx_order(log: DataFrame) -> DataFrame:
    """Adds tx_order: 1-based within the transaction, 0 outside of any."""
    at = F.row_number().over(Window.partitionBy("tx_id").orderBy("seqno"))
    # A null transaction would gather all its rows in one task.
    inside = log.where("tx_id IS NOT NULL").withColumn("tx_order", at)
    return inside.unionByName(log.where("tx_id IS NULL").withColumn("tx_order", F.lit(0)))


def tx_markers(log: DataFrame) -> DataFrame:
    """BEGIN and END of each transaction, at its first and last seqno; END tells how many events it had."""
    tx = log.where("tx_id IS NOT NULL").groupBy("tx_id").agg(F.min("seqno").alias("first"), F.max("seqno").alias("last"), F.count("*").alias("n"))
    mark = lambda kind, at, n: F.struct(F.lit(kind).alias("marker"), F.col(at).alias("seqno"), n.alias("event_count"))
    marks = F.explode(F.array(mark("BEGIN", "first", F.lit(None).cast("bigint")), mark("END", "last", F.col("n"))))
    return tx.select("tx_id", marks.alias("_m")).select("tx_id", "_m.*")


def tx_runs(log: DataFrame, stream: str, width: int = 1_000_000) -> DataFrame:
    """Runs of consecutive events of one transaction within each stream: first and last seqno and how many.

    A stream is cut into ranges of ``width`` positions, which are ordered side by side; the last event of each range
    tells whether the next one goes on with its run, and counts of the runs that start in a range number them.
    """
    x = log.withColumn("_range", F.floor(F.col("seqno") / width))
    order = Window.partitionBy(stream, "_range").orderBy("seqno")
    x = x.withColumn("_first", F.lag("seqno").over(order).isNull()).withColumn("_starts", ~F.lag("tx_id").over(order).eqNullSafe(F.col("tx_id")))
    ranges = x.groupBy(stream, "_range").agg(
        F.min_by(F.struct("tx_id"), "seqno").alias("_head"), F.max_by(F.struct("tx_id"), "seqno").alias("_tail"), F.count_if(~F.col("_first") & F.col("_starts")).alias("_inner")
    )
    along = Window.partitionBy(stream).orderBy("_range")
    goes_on = F.lag("_range").over(along).isNotNull() & F.lag("_tail").over(along)["tx_id"].eqNullSafe(F.col("_head.tx_id"))
    ranges = ranges.withColumn("_goes_on", goes_on).withColumn("_runs", F.col("_inner") + F.when(F.col("_goes_on"), 0).otherwise(1))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_runs").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.join(ranges.select(stream, "_range", "_goes_on", "_before"), [stream, "_range"])
    starts = F.when(F.col("_first"), ~F.col("_goes_on")).otherwise(F.col("_starts"))
    x = x.withColumn("_run", F.col("_before") + F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(stream, "_run").agg(F.first("tx_id").alias("tx_id"), F.min("seqno").alias("first_seqno"), F.max("seqno").alias("last_seqno"), F.count("*").alias("events")).withColumnRenamed("_run", "run")


def tx_complete(log: DataFrame, last: str) -> DataFrame:
    """Events of transactions whose last event is there; events outside of transactions pass."""
    done = log.where(F.col(last)).select("tx_id").distinct()
    return log.where("tx_id IS NOT NULL").join(done, "tx_id", "left_semi").unionByName(log.where("tx_id IS NULL").select("tx_id", *[c for c in log.columns if c != "tx_id"]))


def without_loops(log: DataFrame, marker: str) -> DataFrame:
    """Events before any marker row of their transaction: what came from the other side isn't sent back."""
    first = log.where(F.col(marker)).groupBy("tx_id").agg(F.min("seqno").alias("_marked"))
    return log.join(first, "tx_id", "left").where("_marked IS NULL OR seqno < _marked").drop("_marked")


def low_watermark(log: DataFrame, stream: str, failed: str) -> DataFrame:
    """For each stream the seqno up to which all is done: the largest below the first that failed."""
    first = log.where(F.col(failed)).groupBy(stream).agg(F.min("seqno").alias("_failed"))
    x = log.join(first, stream, "left").where("_failed IS NULL OR seqno < _failed")
    return log.select(stream).distinct().join(x.groupBy(stream).agg(F.max("seqno").alias("watermark")), stream, "left")
