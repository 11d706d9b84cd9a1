"""From a copied snapshot to the log behind it: recorded positions, and the changes that each copied range still lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema_log import as_of

MODES = ("NONE", "GTID_ONLY", "CONSISTENT")


def position_line(at_ms: Column, mode: Column, kind: Column, position: Column) -> Column:
    """The line that records a snapshot's position: time, mode, kind of database and position; null without a position."""
    return F.when(position.isNotNull() & mode.isin(*MODES), F.concat(at_ms.cast("string"), F.lit("|"), mode, F.lit("|"), kind, F.lit("|"), position))


def parsed_position(line: Column) -> Column:
    """at_ms, mode, kind and position of such a line, whose position may hold bars; null where it isn't one."""
    pattern = rf"^(\d{{1,18}})\|({'|'.join(MODES)})\|([^|]*)\|(.+)$"
    part = lambda i: F.regexp_extract(F.trim(line), pattern, i)
    return F.when(F.trim(line).rlike(pattern), F.struct(part(1).try_cast("bigint").alias("at_ms"), part(2).alias("mode"), part(3).alias("kind"), part(4).alias("position")))


def pending_changes(log: DataFrame, ranges: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """The changes of ``log`` (seqno, key) that a copy doesn't hold yet.

    The copy was read in ``ranges`` (low, high, position) of a whole-number key, each as of its own position in the log: of
    a key in a range, changes behind that position are pending; of a key in none, which wasn't copied, all are. Ranges
    don't overlap; each distinct key takes its range by an as-of join over the keys, and the changes take their key's by a
    join, so no task holds all ranges or all changes, however few or hot the keys are.
    """
    bounds = ranges.select(F.col("low").alias(key), F.struct("high", "position").alias("_range"))
    # Where a range ends and no other begins, keys are in none.
    x = log.join(as_of(log.select(key).distinct(), bounds, [], key, "_range", width), key, "left").select(*log.columns, "_range")
    copied = F.col("_range").isNotNull() & (F.col(key) < F.col("_range.high"))
    return x.where(~F.coalesce(copied, F.lit(False)) | (F.col("seqno") > F.col("_range.position"))).drop("_range")


def handed_over(copied: DataFrame, log: DataFrame, ranges: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """The table as of the end of ``log`` (seqno, op, key and the columns of ``copied``): each change counts once.

    Rows of ``copied`` stand until a pending change of their key; of those the last one decides, and a delete leaves no row.
    """
    rest = [c for c in copied.columns if c != key]
    last = pending_changes(log, ranges, key, width).groupBy(key).agg(F.max_by(F.struct("op", *rest), "seqno").alias("_last"))
    changed = last.where("_last.op <> 'd'").select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])
    return copied.join(last, key, "left_anti").unionByName(changed)
