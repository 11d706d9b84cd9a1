"""Sinks: tables by key, databases, shards, rejected rows, messages and index requests."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions.values import row_bytes
from ..operators.changelog import upsert


class KeyedTable:
    """A Parquet table in ``parts`` partitions by a hash of its key; a change rewrites the partitions that it touches.

    New partitions are written aside first and then put in place by Spark's own dynamic overwrite, so that none is
    read while it is written. A job lost between two partitions is made good by running its batch again: changes are
    put by key and position, and what is there already changes nothing.
    """

    PART = "_part"

    def __init__(self, spark: SparkSession, path: str, pk: list[str], parts: int = 64):
        self.spark, self.path, self.pk, self.parts = spark, path, pk, parts

    @staticmethod
    def parts_for(size: int, most: int = 1 << 30) -> int:
        """Partitions for a table that will hold ``size`` bytes: a power of two, none beyond ``most`` bytes on average.

        A partition is what one task rewrites; a table keeps the number it began with.
        """
        return 1 << max(0, (max(size, 1) - 1) // most).bit_length()

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def read(self) -> DataFrame | None:
        """None where nothing was written yet."""
        df = self._stored()
        return None if df is None else df.drop(self.PART)

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.PART, F.pmod(F.xxhash64(*self.pk), F.lit(self.parts)).cast("int"))

    def _touched(self, parts: list[int]) -> DataFrame | None:
        df = self._stored()
        return None if df is None else df.where(F.col(self.PART).isin(parts))

    def _put(self, rows: DataFrame) -> None:
        aside = f"{self.path.rstrip('/')}_aside/{uuid.uuid4().hex}"
        rows.repartition(self.PART).write.partitionBy(self.PART).parquet(aside)
        ready = self.spark.read.schema(rows.schema).parquet(aside)
        ready.repartition(self.PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.PART).parquet(self.path)

    def merge(self, changes: DataFrame) -> None:
        """Put ``changes``, one row a key, over the rows of their keys."""
        changes = written(self._dealt(changes))
        parts = [r[0] for r in changes.select(self.PART).distinct().collect()]  # ``parts`` numbers at most
        if parts:
            now = self._touched(parts)
            self._put(changes if now is None else upsert(now.select(*changes.columns), changes, self.pk))

    def expire(self, before: int, seqno: str = "seqno", op: str = "op") -> None:
        """Forget deletes at positions below ``before``, which no replay reaches any more.

        The last one of a partition stays, so that the partition is written.
        """
        now = self._stored()
        if now is None:
            return
        gone = (F.col(op) == "d") & (F.col(seqno) < before)
        sizes = now.groupBy(self.PART).agg(F.max(seqno).alias("_last"), F.count_if(gone).alias("_gone")).where("_gone > 0")
        rows = now.join(F.broadcast(sizes), self.PART).where(~gone | (F.col(seqno) == F.col("_last")))  # a row a partition
        self._put(rows.select(*now.columns))


def write_jdbc(df: DataFrame, url: str, table: str, pk: list[str], batch: int = 5000, known: str = "keep", **options: str) -> dict[str, int]:
    """Append rows to a table in batches; rows whose key is there already, or comes twice, count as done (``keep``) or as an error.

    Keys of the target are read in one scan of its key columns and left out by an anti-join, so that a job that is
    run again adds only what is missing. Returns rows seen, written and skipped.
    """
    seen, put = Observation(), Observation()
    rows = df.observe(seen, F.count("*").alias("rows"))
    if known == "keep":
        there = df.sparkSession.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*pk)
        rows = rows.dropDuplicates(pk).join(there, pk, "left_anti").select(*df.columns)
    rows = rows.observe(put, F.count("*").alias("rows"))
    rows.write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=batch, **options).save()
    n, done = seen.get["rows"], put.get["rows"]
    return {"rows": n, "written": done, "skipped": n - done}


def load_channel(mode: str, target: str, enabled: bool = True, rows: int = 0, usual: int = 5000) -> tuple[str, int]:
    """The channel of a bulk load and its rows a batch: AUTO is BATCH, COPY is for PostgreSQL and DIRECT_PATH for Oracle alone, else BATCH.

    A load that isn't enabled goes row by row.
    """
    if mode not in ("AUTO", "BATCH", "COPY", "DIRECT_PATH"):
        raise ValueError(f"no channel: {mode}")
    fits = {"COPY": "postgresql", "DIRECT_PATH": "oracle"}.get(mode) == target.strip().lower()
    return (mode if enabled and fits else "BATCH"), (rows if rows > 0 else max(1, usual)) if enabled else 1


def load_bisected(rows: DataFrame, pk: list[str], write: Callable[[DataFrame], object], most_rejects: int = 100) -> DataFrame:
    """Write ``rows`` by ``write``; where that fails, by halves, until the rows that fail stand alone: these come back, with their error.

    Halves are ranges of a hash of the key, so rows are read by range from a table sorted by it, never collected. ``write``
    must be safe to repeat for rows that it has put already, as ``write_jdbc`` is. More than ``most_rejects`` rejects stop
    the load: then something else is wrong than a few rows. A load with r bad rows of n takes about r log n writes.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*pk))
    hashed = written(hashed.repartitionByRange("_h").sortWithinPartitions("_h"))
    todo, said = [(-(1 << 63), (1 << 63) - 1)], []
    while todo:
        low, high = todo.pop()
        part = hashed.where(F.col("_h").between(low, high))
        try:
            write(part.drop("_h"))
            continue
        except Exception as error:  # which row it was is found by halves
            reason = str(getattr(error, "java_exception", None) or error).strip().splitlines()[0][:500]
        ends = part.agg(F.min("_h"), F.max("_h"), F.count("*")).first()
        if ends[0] == ends[1]:  # one row, or rows of one key
            said.append((ends[0], reason))
            if len(said) > most_rejects:
                raise RuntimeError(f"more than {most_rejects} rows can't be written; the last: {reason}")
            continue
        middle = (ends[0] + ends[1]) // 2
        todo += [(middle + 1, ends[1]), (ends[0], middle)]
    errors = rows.sparkSession.createDataFrame(said, "_h bigint, error string")  # ``most_rejects`` rows at most
    return hashed.join(F.broadcast(errors), "_h").drop("_h")


def load_statistics(df: DataFrame, columns: list[str]) -> tuple[DataFrame, Observation]:
    """``df`` and what will be known when it has been written: rows and estimated bytes."""
    told, kinds = Observation(), dict(df.dtypes)
    return df.observe(told, F.count("*").alias("rows"), F.coalesce(F.sum(row_bytes(*[F.col(c) for c in columns], kinds=[kinds[c] for c in columns])), F.lit(0)).alias("bytes")), told


def load_tables(loads: dict[str, Callable[[], object]], workers: int = 4, stop: bool = False) -> dict[str, str]:
    """Run the loads of several tables side by side; what became of each. ``stop``: begin none after one has failed."""
    failed = threading.Event()

    def one(load: Callable[[], object]) -> str:
        if stop and failed.is_set():
            return "not begun"
        try:
            load()
            return "ok"
        except Exception as error:  # each table has its own outcome
            failed.set()
            return f"failed: {type(error).__name__}"

    with ThreadPoolExecutor(workers) as pool:
        return dict(zip(loads, pool.map(one, loads.values()), strict=True))


def route_errors(log: DataFrame, failed: str, skip_events: list[str], skip_positions: list[int], policy: str = "FAIL_STOP") -> tuple[DataFrame, DataFrame]:
    """Events to apply and events set aside. What the skip lists name is set aside; what ``failed`` marks is, by DEAD_LETTER, or stops the job."""
    skipped = F.coalesce(F.col("event_id").isin(skip_events), F.lit(False)) | F.col("seqno").isin(skip_positions)
    bad = ~skipped & F.coalesce(F.col(failed), F.lit(False))
    if policy == "DEAD_LETTER":
        return log.where(~skipped & ~bad), log.where(skipped | bad).withColumn("reason", F.when(skipped, "skipped").otherwise("failed"))
    if policy != "FAIL_STOP":
        raise ValueError(f"no policy: {policy}")
    stop = F.when(bad, F.raise_error(F.concat(F.lit("event failed at "), F.col("seqno").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return log.where(~skipped).where(stop), log.where(skipped).withColumn("reason", F.lit("skipped"))


def write_shards(routed: DataFrame, path: str) -> None:
    """One folder for each target; each is written by as many tasks as have its rows."""
    routed.write.partitionBy("target_db", "target_table").parquet(path)


def split_rejects(df: DataFrame, checks: dict[str, Callable]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with the reasons."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(check(df), F.lit(False)), F.lit(name)) for name, check in checks.items()]))
    x = df.withColumn("reasons", reasons)
    return x.where("size(reasons) = 0").drop("reasons"), x.where("size(reasons) > 0")


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("append").json(path)


def as_messages(topic, key, value, df: DataFrame) -> DataFrame:
    """topic, key and value: what a Kafka sink takes."""
    return df.select(topic.alias("topic"), key.alias("key"), value.alias("value"))


def index_requests(df: DataFrame, db: str, table: str, pk: list[str], op: str = "op") -> DataFrame:
    """Lines of bulk index requests: an action, and for what isn't a delete the document."""
    index, key = f"{db}_{table}".lower(), F.concat_ws("_", *[F.col(c).cast("string") for c in pk])
    target = F.struct(F.lit(index).alias("_index"), key.alias("_id"))
    doc = F.to_json(F.struct(*[F.base64(c).alias(c) if k == "binary" else F.col(c) for c, k in df.dtypes if c != op]))
    head = F.when(F.col(op) == "d", F.to_json(F.struct(target.alias("delete")))).otherwise(F.to_json(F.struct(target.alias("index"))))
    return df.select(F.when(F.col(op) == "d", head).otherwise(F.concat(head, F.lit("\n"), doc)).alias("value"))


def fan_out(batch: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Write one batch to several sinks; what became of each. A sink that fails doesn't keep others from theirs."""
    done = {}
    batch = batch.persist()
    try:
        for name, write in sinks.items():
            try:
                write(batch)
                done[name] = "ok"
            except Exception as error:  # each target has its own outcome
                done[name] = f"failed: {type(error).__name__}"
    finally:
        batch.unpersist()
    return done
