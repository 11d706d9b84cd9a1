"""Latency, throughput, lag, limits and alerts over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from .inputs import epoch_ms, table


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A latency for each event, of its type's table."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tbl"), epoch_ms(F.col("ts")).alias("ts_ms"), F.pmod(F.col("event_id") * 7919, F.lit(6000)).alias("latency_ms"), "user_id")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.latency_percentiles(_latency(spark, sf_dir), ["tbl"], "latency_ms", [50, 95, 99])
    return out.withColumn("level", metrics.latency_level(F.col("avg_ms")))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = metrics.last_n(_latency(spark, sf_dir), ["tbl"], [F.col("event_id").desc()], 20)
    return metrics.latency_summary(metrics.latency_percentiles(newest, ["tbl"], "latency_ms", [95]), "tbl")


def latency_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_n(_latency(spark, sf_dir), ["tbl"], [F.col("event_id").desc()], 60).select("tbl", "event_id", "latency_ms")


def metrics_history_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _latency(spark, sf_dir).withColumn("applied", F.col("event_id"))
    out = metrics.history(x, ["tbl"], "ts_ms", 86_400_000, ["latency_ms"], ["applied"])
    return out.withColumn("latency_ms", F.round("latency_ms", 3))


def throughput_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.throughput(_latency(spark, sf_dir), "ts_ms", 3_600_000)


def slow_sql_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = _latency(spark, sf_dir).orderBy(F.col("event_id").desc()).limit(1000)
    by_table = newest.groupBy("tbl").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("total_ms"), F.max("latency_ms").alias("max_ms"))
    return by_table.agg(
        F.sum("n").alias("total"), F.floor(F.sum("total_ms") / F.sum("n")).cast("bigint").alias("avg_ms"), F.max("max_ms").alias("max_ms"),
        F.min(F.struct(-F.col("n"), F.col("tbl").alias("t")))["t"].alias("most_frequent"),
    )


def task_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders")
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return x.agg(F.count("*").alias("total"), of("O").alias("running"), of("F").alias("completed"), of("P").alias("failed"))


def quota_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("used"))
    return x.withColumn("percent", F.floor(F.col("used") * 100 / 40).cast("bigint"))


def prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return metrics.prometheus(x, "events_total", "event_type", "n")


def checkpoint_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("written"))
    applied = F.when(F.col("user_id") % 20 != 0, F.col("written") - F.col("user_id") * 9)
    pending, level = metrics.checkpoint_gap(F.col("written"), applied)
    return x.select("user_id", F.coalesce(pending, F.lit(-1)).cast("bigint").alias("pending"), level.alias("level"))


def replication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_id", epoch_ms(F.col("ts")).alias("at"))
    applied = F.when(F.col("event_id") % 9 != 0, F.col("at") + F.col("event_id") % 5 - 2)
    return x.select("event_id", metrics.replication_lag(F.col("at"), applied).alias("lag_ms"))


#: Rules of the alert query: metric, operator, limit.
RULES = [("latency_ms", "GT", 5000.0), ("latency_ms", "LTE", 10.0), ("score", "GTE", 90.0), ("score", "EQ", 5.0), ("missing", "LT", 1.0)]


def alert_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _latency(spark, sf_dir).select("event_id", F.create_map(F.lit("latency_ms"), F.col("latency_ms").cast("double"), F.lit("score"), F.pmod("event_id", F.lit(100)).cast("double")).alias("m"))
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(m).alias("metric"), F.lit(op).alias("op"), F.lit(v).alias("limit")) for i, (m, op, v) in enumerate(RULES)])
    x = x.select("event_id", "m", F.explode(rules).alias("r"))
    hit = metrics.breached(F.element_at("m", F.col("r.metric")), F.col("r.op"), F.col("r.limit"))
    return x.where(hit).select("event_id", F.col("r.rule").alias("rule"), F.col("r.metric").alias("metric"))


def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = (F.col("event_id") % 12).cast("int")
    return table(spark, sf_dir, "events").select("event_id", metrics.backoff(attempt, 100, 2.0, 60_000).alias("delay_ms"))


def having_all_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").withColumn("ref", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")))
    return x.groupBy("o_custkey").agg(F.sum(F.col("ref").isNull().cast("int")).alias("nulls"), F.count("*").alias("n")).where("nulls = 0").select("o_custkey", "n")


def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_id", "event_type", epoch_ms(F.col("ts")).alias("at"))
    return metrics.window_quota(x, ["event_type"], "at", "event_id", 3_600_000, 2).select("event_id", "within")


def api_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_id", "user_id", epoch_ms(F.col("ts")).alias("at"))
    return metrics.window_quota(x, ["user_id"], "at", "event_id", 86_400_000, 1).where("NOT within").select("event_id", "user_id")


QUERIES = {
    f.__name__: f
    for f in (
        latency_percentiles, latency_summary, latency_last_n, metrics_history_bucket, throughput_per_window, slow_sql_stats, task_status_counts, quota_usage, prometheus_lines,
        checkpoint_gap, replication_lag, alert_eval, retry_backoff, having_all_not_null, rate_limit_windows, api_rate_limit,
    )
}

_X = "x AS (SELECT event_id, event_type AS tbl, (epoch_us(ts) // 1000) AS ts_ms, (event_id * 7919) % 6000 AS latency_ms, user_id FROM events)"
SQL = {
    "latency_percentiles": f"""WITH {_X} SELECT tbl, count(*) AS samples, (sum(latency_ms) // count(*))::BIGINT AS avg_ms, max(latency_ms) AS max_ms, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95,
        quantile_disc(latency_ms, 0.99) AS p99, CASE WHEN sum(latency_ms) // count(*) < 100 THEN 'EXCELLENT' WHEN sum(latency_ms) // count(*) < 500 THEN 'GOOD' WHEN sum(latency_ms) // count(*) < 1000 THEN 'NORMAL'
        WHEN sum(latency_ms) // count(*) < 5000 THEN 'WARNING' ELSE 'CRITICAL' END AS level FROM x GROUP BY tbl""",
    "latency_summary": f"""WITH {_X}, n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY event_id DESC) <= 20), t AS (SELECT tbl, (sum(latency_ms) // count(*))::BIGINT AS a FROM n GROUP BY tbl)
        SELECT count(*) AS tables, (sum(a) // count(*))::BIGINT AS mean_avg_ms, max(a) AS max_avg_ms, (SELECT tbl FROM t ORDER BY a DESC, tbl LIMIT 1) AS bottleneck FROM t""",
    "latency_last_n": f"WITH {_X} SELECT tbl, event_id, latency_ms FROM x QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY event_id DESC) <= 60",
    "metrics_history_bucket": f"WITH {_X} SELECT tbl, ts_ms // 86400000 * 86400000 AS bucket, round(avg(latency_ms), 3) AS latency_ms, max(event_id) AS applied FROM x GROUP BY ALL",
    "throughput_per_window": f"WITH {_X} SELECT ts_ms // 3600000 * 3600000 AS window_start, count(*) AS events, count(*) * 1000 // 3600000 AS per_second FROM x GROUP BY 1",
    "slow_sql_stats": f"""WITH {_X}, n AS (SELECT * FROM x ORDER BY event_id DESC LIMIT 1000) SELECT count(*) AS total, (sum(latency_ms) // count(*))::BIGINT AS avg_ms, max(latency_ms) AS max_ms,
        (SELECT tbl FROM n GROUP BY tbl ORDER BY count(*) DESC, tbl LIMIT 1) AS most_frequent FROM n""",
    "task_status_counts": "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS running, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders",
    "quota_usage": "SELECT o_custkey, count(*) AS used, count(*) * 100 // 40 AS percent FROM orders GROUP BY o_custkey",
    "prometheus_lines": """SELECT 'events_total{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""",
    "checkpoint_gap": """WITH w AS (SELECT user_id, max(event_id) AS written FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 20 = 0 THEN -1 ELSE user_id * 9 END AS pending,
  CASE WHEN user_id % 20 = 0 THEN 'PARTIAL' WHEN user_id * 9 > 1000 THEN 'CRITICAL' WHEN user_id * 9 > 100 THEN 'WARNING' ELSE 'HEALTHY' END AS level FROM w""",
    "replication_lag": "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN -1 ELSE greatest(0, 2 - event_id % 5) END::BIGINT AS lag_ms FROM events",
    "alert_eval": f"""WITH {_X} SELECT event_id, 0 AS rule, 'latency_ms' AS metric FROM x WHERE latency_ms > 5000 UNION ALL SELECT event_id, 1, 'latency_ms' FROM x WHERE latency_ms <= 10
        UNION ALL SELECT event_id, 2, 'score' FROM x WHERE event_id % 100 >= 90 UNION ALL SELECT event_id, 3, 'score' FROM x WHERE event_id % 100 = 5""",
    "retry_backoff": "SELECT event_id, least(100 * pow(2, event_id % 12), 60000)::BIGINT AS delay_ms FROM events",
    "having_all_not_null": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderkey % 11 = 0) = 0",
    "rate_limit_windows": "SELECT event_id, row_number() OVER (PARTITION BY event_type, (epoch_us(ts) // 1000) // 3600000 ORDER BY event_id) <= 2 AS within FROM events",
    "api_rate_limit": "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, (epoch_us(ts) // 1000) // 86400000 ORDER BY event_id) > 1",
}
