"""Latency, lag, throughput, limits and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import WIDTH, before


def latency_level(ms: Column) -> Column:
    return F.when(ms < 100, "EXCELLENT").when(ms < 500, "GOOD").when(ms < 1000, "NORMAL").when(ms < 5000, "WARNING").otherwise("CRITICAL")


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest ``n`` rows of each key; Spark keeps no more than that of a key in a task before the shuffle."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_at") <= n).drop("_at")


def latency_percentiles(df: DataFrame, keys: list[str], value: str, points: list[int]) -> DataFrame:
    """Nearest-rank percentiles, count, whole mean and maximum."""
    ranks = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY `{value}`)").cast("bigint").alias(f"p{p}") for p in points]
    return df.groupBy(*keys).agg(F.count("*").alias("samples"), F.floor(F.sum(value) / F.count("*")).cast("bigint").alias("avg_ms"), F.max(value).alias("max_ms"), *ranks)


def latency_summary(per_table: DataFrame, name: str) -> DataFrame:
    """Tables, mean of their means, the largest, and the table that has it (the first by name of several)."""
    return per_table.agg(
        F.count("*").alias("tables"), F.floor(F.sum("avg_ms") / F.count("*")).cast("bigint").alias("mean_avg_ms"), F.max("avg_ms").alias("max_avg_ms"),
        F.min(F.struct(-F.col("avg_ms"), F.col(name).alias("n")))["n"].alias("bottleneck"),
    )


def history(df: DataFrame, keys: list[str], ts_ms: str, interval_ms: int, gauges: list[str], counters: list[str]) -> DataFrame:
    """Buckets of a series: means of gauges, maxima of counters. Up to 30 s the rows themselves."""
    if interval_ms <= 30_000:
        return df.select(*keys, F.col(ts_ms).alias("bucket"), *gauges, *counters)
    bucket = (F.floor(F.col(ts_ms) / interval_ms) * interval_ms).cast("bigint")
    return df.groupBy(*keys, bucket.alias("bucket")).agg(*[F.avg(c).alias(c) for c in gauges], *[F.max(c).alias(c) for c in counters])


def throughput(df: DataFrame, ts_ms: str, window_ms: int) -> DataFrame:
    start = (F.floor(F.col(ts_ms) / window_ms) * window_ms).cast("bigint")
    return df.groupBy(start.alias("window_start")).agg(F.count("*").alias("events"), F.floor(F.count("*") * 1000 / window_ms).cast("bigint").alias("per_second"))


def checkpoint_gap(written: Column, applied: Column) -> tuple[Column, Column]:
    """Events pending and what that means."""
    pending = F.when(written.isNotNull() & applied.isNotNull(), F.greatest(F.lit(0), written - applied))
    level = F.when(written.isNull() & applied.isNull(), "NO_DATA").when(written.isNull() | applied.isNull(), "PARTIAL").when(pending > 1000, "CRITICAL").when(pending > 100, "WARNING").otherwise("HEALTHY")
    return pending, level


def replication_lag(source_now: Column, applied: Column) -> Column:
    """Milliseconds, never negative; -1 where unknown."""
    behind = source_now - applied
    return F.when(behind.isNull(), -1).otherwise(F.greatest(F.lit(0), behind)).cast("bigint")


def recovery_time(now_ms: Column, source_ms: Column) -> Column:
    """Milliseconds from the newest applied event to now; null where unknown or negative, as clocks that disagree say nothing."""
    behind = now_ms - source_ms
    return F.when(behind >= 0, behind)


def slowest(per_table: DataFrame, name: str) -> DataFrame:
    """Tables with their rank by mean latency, the slowest first. One row a table: the window is as small as the catalog."""
    return per_table.withColumn("rank", F.row_number().over(Window.orderBy(F.col("avg_ms").desc(), name)))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a history, numbered from 0; for far pages go on from a key instead (see the keyset page)."""
    return df.orderBy(*order).offset(number * size).limit(size)


def kept_history(df: DataFrame, at_ms: str, now_ms: int, days: int) -> DataFrame:
    """Rows that retention leaves."""
    return df.where(F.col(at_ms) >= now_ms - days * 86_400_000)


def task_search(tasks: DataFrame, text: list[str], keyword: str | None = None, **equal: str | None) -> DataFrame:
    """Tasks that aren't deleted, whose named columns hold the keyword in any case, and others are equal to what is asked."""
    x = tasks.where(~F.coalesce(F.col("deleted"), F.lit(False)))
    if keyword:
        x = x.where(reduce(Column.__or__, [F.coalesce(F.lower(c).contains(keyword.lower()), F.lit(False)) for c in text]))
    for column, value in equal.items():
        x = x if value is None else x.where(F.col(column) == value)
    return x


def masked_settings(line: Column) -> Column:
    """A settings line with the values of secrets masked."""
    return F.regexp_replace(line, r"(?i)^(\s*[\w.-]*(?:password|passwd|secret|token|access[._-]?key|private[._-]?key)[\w.-]*\s*[=:]\s*)\S.*$", "$1******")


def breached(value: Column, op: Column, limit: Column) -> Column:
    """Whether a metric meets its rule's condition; a metric that isn't there meets none."""
    found = (
        F.when(op == "GT", value > limit).when(op == "GTE", value >= limit).when(op == "LT", value < limit).when(op == "LTE", value <= limit)
        .when(op == "EQ", F.abs(value - limit) < 0.001)
    )
    return F.coalesce(found, F.lit(False))


def backoff(attempt: Column, first_ms: int, factor: float, most_ms: int) -> Column:
    return F.least(F.lit(float(first_ms)) * F.pow(F.lit(factor), attempt), F.lit(float(most_ms))).cast("bigint")


def window_quota(df: DataFrame, keys: list[str], at_ms: str, order: str, window_ms: int, quota: int, width: int = WIDTH) -> DataFrame:
    """Adds within: whether the row is among the first ``quota`` of its key in its fixed window; rows without a time share one."""
    x = df.withColumn("_window", F.floor(F.col(at_ms) / window_ms).cast("bigint"))
    x = before(x, [*keys, "_window"], order, {"_n": ("sum", F.lit(1).cast("long"))}, width)
    return x.withColumn("within", F.coalesce("_n", F.lit(0)) < quota).drop("_window", "_n")


def monotone(df: DataFrame, keys: list[str], order: str, phase: str, exempt: str, width: int = WIDTH) -> DataFrame:
    """Adds accepted: whether a status isn't behind the furthest phase so far; exempt ones always are."""
    x = before(df, keys, order, {"_furthest": ("max", F.when(~F.col(exempt), F.col(phase)))}, width)
    return x.withColumn("accepted", F.col(exempt) | F.col("_furthest").isNull() | (F.col(phase) >= F.col("_furthest"))).drop("_furthest")


def prometheus(df: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    return df.select(F.format_string(f'{metric}{{{label}="%s"}} %d', F.col(label).cast("string"), F.col(value).cast("bigint")).alias("line"))
