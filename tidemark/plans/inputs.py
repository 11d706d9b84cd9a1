"""Tables, and the change log and the pair of tables that the queries derive from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table's unique key and columns, dealt over tasks: a file with few row groups is read by few, too few for costly expressions over text.

    By the key, as rows dealt in turn are sorted in the task that reads them.
    """
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, sf_dir, name).select(key, *columns).repartition(parts, key)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a time without zone, in UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as changes of users: signups insert, errors delete, the rest update; four events a transaction."""
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seqno"), F.col("user_id").alias("pk"), op.alias("op"), F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")).alias("node"),
        F.floor(F.col("event_id") / 4).cast("bigint").alias("tx_id"), F.col("ts").alias("source_ts"), "event_type", "value",
    )


#: The same in SQL.
LOG = """log AS (SELECT event_id AS seqno, user_id AS pk, CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op,
  'n' || (event_id % 3) AS node, event_id // 4 AS tx_id, ts AS source_ts, event_type, value FROM events)"""


def order_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders, and a target that lacks some rows, has some of its own and others with another price."""
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    kept = source.where("o_orderkey % 97 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 89 == 0, F.round(F.col("o_totalprice") + 1, 2)).otherwise(F.col("o_totalprice")))
    own = source.where("o_orderkey % 101 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000)
    return source, kept.unionByName(own)


PAIR = """source AS (SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders),
target AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 89 = 0 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS o_totalprice
             FROM source WHERE o_orderkey % 97 <> 0
           UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice FROM source WHERE o_orderkey % 101 = 0)"""
