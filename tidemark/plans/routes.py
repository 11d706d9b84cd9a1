"""Splitting tables over shards and merging them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, routing
from ..operators.routing import SplitRule
from .inputs import table

HASH = SplitRule("user_key", "hash_mod", count=8, database="dw_${shard/4}", table="orders_${shard}", nodes=2)
RANGE = SplitRule("o_orderkey", "range", ranges=((0, 1000), (1000, 5000), (5000, 20000)), table="orders_${shard}", unrouted="deadletter")
LIST = SplitRule("c_mktsegment", "list", values=(("BUILDING", 0), ("automobile", 1), ("MACHINERY", 2), ("HOUSEHOLD", 3)), table="customer_${shard}", unrouted="deadletter", nodes=4)
DATE = SplitRule("o_orderdate", "date_format", pattern="yyyyMM", table="orders_${shard}")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose key is null now and then."""
    key = F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("user_key"))


def route_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.split_route(_orders(spark, sf_dir).where("user_key IS NOT NULL"), HASH).select("o_orderkey", "shard", "target_db", "target_table", "target_node")


def route_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.split_route(_orders(spark, sf_dir).where("user_key IS NULL"), HASH).select("o_orderkey", "shard", "target_db", "target_table", "target_node")


def route_split_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey")
    return routing.split_route(x, RANGE).select("o_orderkey", "shard", "target_table")


def route_split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    routed = routing.split_route(x, LIST)
    return routed.where("shard IS NOT NULL").select("c_custkey", "shard", "target_table", "target_node")


def route_split_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return routing.split_route(x, DATE).select("o_orderkey", "target_table")


def route_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_hits(routing.split_route(_orders(spark, sf_dir), HASH))


def route_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_skew(route_hits(spark, sf_dir))


def scan_pk_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.scan_ranges(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", 16)


def _party_sources(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, str, DataFrame]]:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return [("n1", "shop", "customer", c), ("n2", "shop", "supplier", s)]


def _parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.merge_tagged(_party_sources(spark, sf_dir), ["id", "name", "nation"])


def merge_union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parties(spark, sf_dir)


def merge_keep_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.merge_keep_key(_parties(spark, sf_dir), ["id"], [F.col("src_node")]).select("id", "name", "nation", "src_table")


def compare_merge_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source against its slice of a merged table that has lost some rows."""
    merged = _parties(spark, sf_dir).where("src_node <> 'n1' OR id % 31 <> 0")
    return compare.slice_counts(_party_sources(spark, sf_dir), merged)


def compare_split_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _orders(spark, sf_dir).where("user_key IS NOT NULL")
    return compare.count_difference([("orders", source, routing.split_route(source, HASH))])


def cdc_cross_shard_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("old_key"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 8).otherwise(F.col("o_custkey") + F.col("o_orderkey") % 5).alias("new_key"))
    return routing.cross_shard_moves(x, SplitRule("new_key", "hash_mod", count=8), "old_key", "new_key")


QUERIES = {f.__name__: f for f in (route_split_hash, route_broadcast, route_split_range, route_split_list, route_split_date, route_hits, route_skew, scan_pk_range_shards, merge_union_tagged, merge_keep_pk, compare_merge_slice, compare_split_sum, cdc_cross_shard_move)}

_HASHED = "'dw_' || (shard // 4) AS target_db, 'orders_' || shard AS target_table"
_HITS = f"""h AS (SELECT o_orderkey, o_custkey % 8 AS shard FROM orders WHERE o_custkey % 50 <> 0 UNION ALL SELECT o_orderkey, s.i FROM orders, range(8) AS s(i) WHERE o_custkey % 50 = 0),
t AS (SELECT {_HASHED} FROM h), c AS (SELECT target_db, target_table, count(*) AS rows FROM t GROUP BY ALL)"""
_PARTIES = """p AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, 'n1' AS src_node, 'shop' AS src_db, 'customer' AS src_table FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'n2', 'shop', 'supplier' FROM supplier)"""

SQL = {
    "route_split_hash": f"SELECT o_orderkey, shard, {_HASHED}, (shard // 4)::INT AS target_node FROM (SELECT o_orderkey, (o_custkey % 8)::INT AS shard FROM orders WHERE o_custkey % 50 <> 0)",
    "route_broadcast": f"SELECT o_orderkey, shard, {_HASHED}, (shard // 4)::INT AS target_node FROM (SELECT o_orderkey, s.i::INT AS shard FROM orders, range(8) AS s(i) WHERE o_custkey % 50 = 0)",
    "route_split_range": "SELECT o_orderkey, shard, 'orders_' || shard AS target_table FROM (SELECT o_orderkey, CASE WHEN o_orderkey >= 0 AND o_orderkey < 1000 THEN 0 WHEN o_orderkey < 5000 THEN 1 WHEN o_orderkey < 20000 THEN 2 END AS shard FROM orders)",
    "route_split_list": "SELECT c_custkey, shard, 'customer_' || shard AS target_table, shard AS target_node FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 3 END::INT AS shard FROM customer) WHERE shard IS NOT NULL",
    "route_split_date": "SELECT o_orderkey, 'orders_' || strftime(o_orderdate, '%Y%m') AS target_table FROM orders",
    "route_hits": f"WITH {_HITS} SELECT * FROM c",
    "route_skew": f"WITH {_HITS} SELECT *, round(100 * rows / sum(rows) OVER (), 4) AS share, count(*) OVER () > 1 AND max(rows) OVER () * count(*) OVER () > 2 * sum(rows) OVER () AS skewed FROM c",
    "scan_pk_range_shards": """WITH b AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem), w AS (SELECT lo, hi, (hi - lo + least(16, hi - lo + 1)) // least(16, hi - lo + 1) AS width FROM b)
        SELECT part, lo - 1 + part * width AS low, least(lo - 1 + (part + 1) * width, hi) AS high, count(*) AS rows FROM (SELECT (l_orderkey - lo) // width AS part, lo, hi, width FROM lineitem, w) GROUP BY part, lo, hi, width""",
    "merge_union_tagged": f"WITH {_PARTIES} SELECT * FROM p",
    "merge_keep_pk": f"WITH {_PARTIES} SELECT id, arg_max(name, src_node) AS name, arg_max(nation, src_node) AS nation, arg_max(src_table, src_node) AS src_table FROM p GROUP BY id",
    "compare_merge_slice": f"""WITH {_PARTIES} SELECT src_node, src_db, src_table, count(*) AS source_count, count(*) FILTER (WHERE src_node <> 'n1' OR id % 31 <> 0) AS target_count,
        count(*) FILTER (WHERE src_node = 'n1' AND id % 31 = 0) AS difference FROM p GROUP BY ALL""",
    "compare_split_sum": "SELECT 'orders' AS table_name, count(*) AS source_count, count(*) AS target_count, 0::BIGINT AS difference FROM orders WHERE o_custkey % 50 <> 0",
    "cdc_cross_shard_move": """WITH x AS (SELECT o_orderkey, o_custkey AS old_key, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 8 ELSE o_custkey + o_orderkey % 5 END AS new_key FROM orders)
        SELECT *, 'UPDATE' AS action, (new_key % 8)::INT AS shard FROM x WHERE old_key % 8 = new_key % 8
        UNION ALL SELECT *, 'DELETE', (old_key % 8)::INT FROM x WHERE old_key % 8 <> new_key % 8 UNION ALL SELECT *, 'INSERT', (new_key % 8)::INT FROM x WHERE old_key % 8 <> new_key % 8""",
}
