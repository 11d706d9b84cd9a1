"""Comparison of a source with its target, and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import written
from ..operators import compare, digest_tree
from .inputs import PAIR, epoch_ms, order_pair, table

COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def compare_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = order_pair(spark, sf_dir)
    return compare.count_difference([("orders", source, target)])


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.fingerprint(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


def table_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_tree.checksum(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderkey"], 64, 2)


def digest_tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that differ, and rows below them, at each level of two tables' trees; the last are read again."""
    source, target = order_pair(spark, sf_dir)
    changed = source.where("o_orderkey % 997 <> 5").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 1009 == 7, F.lit(None)).otherwise(F.col("o_totalprice")))
    found = digest_tree.unequal(source, changed, source.columns, ["o_orderkey"], 64, 2)
    return spark.createDataFrame([(*x, *([0, 0] if i < 2 else [found.source.count(), found.target.count()])) for i, x in enumerate(found.levels)], "depth int, nodes long, rows_below long, source_again long, target_again long")


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.row_diff(*order_pair(spark, sf_dir), ["o_orderkey"])


def diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).select("o_orderkey", "diff_type")


def diff_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).where("diff_type = 'CONTENT_DIFF'").select("o_orderkey", "fields")


def missing_rows_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = order_pair(spark, sf_dir)
    return source.join(target, "o_orderkey", "left_anti")


def repair_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.repair_actions(_diff(spark, sf_dir)).select("o_orderkey", "action")


def repair_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = order_pair(spark, sf_dir)
    fixed = compare.repaired(source, target, written(_diff(spark, sf_dir)), ["o_orderkey"])
    left = compare.row_diff(source, fixed, ["o_orderkey"]).agg(F.count("*").alias("left_over"))
    return left.withColumn("table_name", F.lit("orders"))


def content_compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = order_pair(spark, sf_dir)
    same = table(spark, sf_dir, "customer")
    return compare.content_compare("orders", source, target, ["o_orderkey"]).unionByName(compare.content_compare("customer", same, same.repartition(3), ["c_custkey"]))


def diff_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred differences, as a report shows them."""
    return compare.capped(_diff(spark, sf_dir).select("o_orderkey", "diff_type"), ["o_orderkey"])


def diff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"))
    source = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    shifted = F.map_concat(F.map_filter("doc", lambda k, v: k != "k"), F.create_map(F.lit("k"), F.when(F.col("event_id") % 13 == 0, F.lit("changed")).otherwise(F.element_at("doc", "k"))))
    target = source.where("event_id % 17 <> 0").select("event_id", shifted.alias("doc"))
    return compare.document_diff(source, target, "event_id", "doc")


def bidi_recent_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both nodes wrote within the last day of the log."""
    x = table(spark, sf_dir, "events").select((F.col("event_id") % 2).alias("side"), epoch_ms(F.col("ts")).alias("at"))
    last = x.agg(F.max("at")).first()[0] or 0
    recent = x.where(F.col("at") >= last - 86_400_000).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    return recent.select("a", "b", ((F.col("a") > 0) & (F.col("b") > 0)).alias("suspected"))


def precheck_out_of_scope_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents that rows refer to and the selection lacks."""
    chosen = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    parents = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent")).distinct()
    return parents.join(chosen, F.col("parent") == F.col("c_custkey"), "left_anti")


def scope_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target names that several sources would take."""
    a = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 700).alias("name")).distinct()
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 600).alias("name")).distinct()
    return a.intersect(b)


QUERIES = {f.__name__: f for f in (compare_row_count, table_fingerprint, table_checksum, digest_tree_levels, diff_rows, diff_fields, missing_rows_anti, repair_actions, repair_verify, content_compare_summary, diff_capped, diff_documents, bidi_recent_updates, precheck_out_of_scope_fk, scope_conflicts)}

_CELL = lambda c: f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_DIGEST = f"md5({' || '.join(map(_CELL, ('o_orderkey', 'o_custkey', 'o_orderstatus')))})"
_PART = lambda at: f"('0x' || substr({_DIGEST}, {at}, 15))::BIGINT"
_TOTALS = f"coalesce(sum({_PART(1)}), 0)::VARCHAR AS sum_a, coalesce(bit_xor({_PART(1)}), 0) AS xor_a, coalesce(sum({_PART(16)}), 0)::VARCHAR AS sum_b, coalesce(bit_xor({_PART(16)}), 0) AS xor_b"
#: The place of an order's key in a tree of 64 * 64 leaves, as ``digest_tree.Places`` has it.
_PLACE = lambda low, high: f"floor((o_orderkey::DOUBLE - {low}) / greatest(({high}) - ({low}), 1.0) * 4095.0)::BIGINT"
_DIFF = f"""{PAIR}, d AS (SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'SOURCE_ONLY' WHEN s.o_orderkey IS NULL THEN 'TARGET_ONLY'
  WHEN s.o_totalprice <> t.o_totalprice THEN 'CONTENT_DIFF' END AS diff_type FROM source s FULL OUTER JOIN target t ON s.o_orderkey = t.o_orderkey)"""

SQL = {
    "compare_row_count": f"WITH {PAIR} SELECT 'orders' AS table_name, (SELECT count(*) FROM source) AS source_count, (SELECT count(*) FROM target) AS target_count, abs((SELECT count(*) FROM source) - (SELECT count(*) FROM target)) AS difference",
    "table_fingerprint": f"SELECT count(*) AS row_count, {_TOTALS} FROM orders",
    "table_checksum": f"""WITH e AS (SELECT min(o_orderkey)::DOUBLE AS low, max(o_orderkey)::DOUBLE AS high FROM orders),
        l AS (SELECT {_PLACE("(SELECT low FROM e)", "(SELECT high FROM e)")} AS node, count(*) AS n, {_TOTALS} FROM orders GROUP BY 1),
        a AS (SELECT node, n, md5(n || ':' || sum_a || ':' || xor_a || ':' || sum_b || ':' || xor_b) AS d FROM l),
        b AS (SELECT node // 64 AS node, sum(n) AS n, md5(string_agg(node || '=' || d, ',' ORDER BY node)) AS d FROM a GROUP BY 1)
        SELECT sum(n)::BIGINT AS row_count, md5(string_agg(node || '=' || d, ',' ORDER BY node)) AS checksum FROM b""",
    "digest_tree_levels": f"""WITH {PAIR}, changed AS (SELECT o_orderkey, o_orderkey % 997 = 5 AS gone, o_orderkey % 1009 = 7 AS other FROM source),
        e AS (SELECT min(o_orderkey)::DOUBLE AS low, max(o_orderkey)::DOUBLE AS high FROM source),
        p AS (SELECT *, {_PLACE("(SELECT low FROM e)", "(SELECT high FROM e)")} AS leaf FROM changed),
        x AS (SELECT depth, CASE depth WHEN 0 THEN 0 WHEN 1 THEN leaf // 64 ELSE leaf END AS node, count(*) AS s, count(*) FILTER (WHERE NOT gone) AS t, bool_or(gone OR other) AS bad FROM p, range(3) AS r(depth) GROUP BY 1, 2)
        SELECT depth::INT AS depth, count(*) AS nodes, sum(s + t)::BIGINT AS rows_below, CASE WHEN depth < 2 THEN 0 ELSE sum(s) END::BIGINT AS source_again, CASE WHEN depth < 2 THEN 0 ELSE sum(t) END::BIGINT AS target_again
        FROM x WHERE bad GROUP BY depth""",
    "diff_rows": f"WITH {_DIFF} SELECT * FROM d WHERE diff_type IS NOT NULL",
    "diff_fields": f"WITH {_DIFF} SELECT o_orderkey, 'o_totalprice' AS fields FROM d WHERE diff_type = 'CONTENT_DIFF'",
    "missing_rows_anti": f"WITH {PAIR} SELECT * FROM source WHERE o_orderkey NOT IN (SELECT o_orderkey FROM target)",
    "repair_actions": f"WITH {_DIFF} SELECT o_orderkey, CASE WHEN diff_type = 'TARGET_ONLY' THEN 'DELETE' ELSE 'UPSERT' END AS action FROM d WHERE diff_type IS NOT NULL",
    "repair_verify": "SELECT 0::BIGINT AS left_over, 'orders' AS table_name",
    "content_compare_summary": f"""WITH {_DIFF} SELECT 'orders' AS table_name, count(*) FILTER (WHERE diff_type = 'SOURCE_ONLY') AS source_only, count(*) FILTER (WHERE diff_type = 'TARGET_ONLY') AS target_only,
        count(*) FILTER (WHERE diff_type = 'CONTENT_DIFF') AS content_diff, CASE WHEN count(diff_type) = 0 THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM d
        UNION ALL SELECT 'customer', 0, 0, 0, 'MATCH'""",
    "diff_capped": f"WITH {_DIFF} SELECT * FROM d WHERE diff_type IS NOT NULL ORDER BY o_orderkey LIMIT 100",
    "diff_documents": """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'SOURCE_ONLY' ELSE 'CONTENT_DIFF' END AS diff_type, CASE WHEN event_id % 17 = 0 THEN '' ELSE 'k' END AS fields
        FROM events WHERE event_id % 17 = 0 OR event_id % 13 = 0""",
    "bidi_recent_updates": """WITH x AS (SELECT event_id % 2 AS side, (epoch_us(ts) // 1000) AS at_ms FROM events), r AS (SELECT count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM x WHERE at_ms >= (SELECT max(at_ms) FROM x) - 86400000)
        SELECT a, b, a > 0 AND b > 0 AS suspected FROM r""",
    "precheck_out_of_scope_fk": "SELECT DISTINCT o_custkey AS parent FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)",
    "scope_conflicts": "SELECT c_custkey % 700 AS name FROM customer INTERSECT SELECT s_suppkey + 600 FROM supplier",
}
