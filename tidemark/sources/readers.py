"""Sources: tables by key range, change logs from a position, captured lines and latency files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separates the fields of captured lines.
FIELD = "\u0001"


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table; with a numeric ``key`` in ranges between its bounds, read side by side. Filters go to the database."""
    reader = lambda t: spark.read.format("jdbc").options(url=url, dbtable=t, **options)
    if key is None:
        return reader(table).load()
    low, high = reader(f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) b").load().first()
    if low is None:
        return reader(table).load()
    return reader(table).options(partitionColumn=key, lowerBound=low, upperBound=high + 1, numPartitions=max(1, min(partitions, high - low + 1))).load()


def read_log(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """A change log in Parquet, from behind a position: files sorted by seqno are skipped by their bounds."""
    log = spark.read.parquet(path)
    return log if after is None else log.where(F.col("seqno") > after)


def read_captured(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Captured lines as named columns; lines with another number of fields keep their text alone."""
    parts = F.split("value", FIELD)
    fits = F.size(parts) == len(columns)
    named = [F.when(fits, F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(columns)]
    return spark.read.text(path).select(*named, F.when(~fits, F.col("value")).alias("raw"))


def read_latencies(spark: SparkSession, path: str) -> DataFrame:
    """applied_ts, event_ts, latency_ms and op of tab-separated latency files, with the file they are from."""
    schema = "applied_ts LONG, event_ts LONG, latency_ms LONG, op STRING"
    return spark.read.csv(path, sep="\t", schema=schema).withColumn("file", F.input_file_name())


def read_sealed(log: DataFrame, payload: str, key: str) -> DataFrame:
    """A log whose payload is sealed with AES-GCM."""
    return log.withColumn(payload, F.aes_decrypt(payload, F.lit(key)).cast("string"))
