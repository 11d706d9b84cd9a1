"""Row pipelines: filters, column rules, values and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, masking, statements, values
from .inputs import LOG, change_log, table


def filter_exclude_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return columns.keep_rows(x, "o_totalprice|>|300000;status|=|F")


def column_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return columns.rename(x, {"O_CUSTKEY": "customer", "o_orderstatus": "status"})


def column_extra_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.add_constants(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), {"source_db": "sales", "batch": "b1"})


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = F.concat(F.lit("db"), (F.col("user_id") % 5).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", db.alias("db"), F.col("event_type").alias("tbl"))


def schema_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _named(spark, sf_dir)
    name = F.concat_ws(".", "db", "tbl")
    return x.where(columns.in_scope(name, ["DB*.c*", "db?.view"], ["db3.*"]))


def event_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_id", "event_type")
    return x.where(columns.event_wanted(F.col("event_type"), ["sign"], ["i", "purchase"]))


def table_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Whole names first, then tables; a short list that is part of the program.
    whole, short = {"db1.click": "dw1.clicks", "db2.view": "views2"}, {"click": "all_clicks", "error": "ops.errors"}
    name = F.concat_ws(".", "db", "tbl")
    of = lambda m, by: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), by)
    to = F.coalesce(of(whole, name), of(short, F.col("tbl")), F.col("tbl"))
    full = F.when(F.instr(to, ".") > 0, to).otherwise(F.concat_ws(".", F.col("db"), to))
    return _named(spark, sf_dir).select("event_id", full.alias("target"))


def enrich_table_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.select("c_custkey", "n_name", "r_name")


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey > 100").orderBy("o_orderkey").limit(1000).select("o_orderkey", "o_custkey")


def update_minimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders")
    image = lambda price: F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("half"), price)
    before, after = image((F.col("o_orderkey") % 2).cast("string")), image((F.col("o_custkey") % 2).cast("string"))
    changed = columns.changed_only(before, after)
    return x.select("o_orderkey", F.array_join(F.array_sort(F.map_keys(changed)), ",").alias("changed"), F.element_at(changed, "half").alias("half"))


def document_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.from_json("props", "map<string,string>")
    k = F.element_at(doc, "k")
    x = table(spark, sf_dir, "events").withColumn("k", k).where(~F.coalesce(k.try_cast("bigint") < 20, F.lit(False)))
    return x.select("event_id", F.col("k").alias("renamed"), F.lit("events").alias("origin"))


def case_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _named(spark, sf_dir)
    return x.select("event_id", columns.changed_case(F.col("db"), "upper").alias("db"), columns.changed_case(F.col("tbl"), "lower").alias("tbl"))


def value_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        values.enum_label(n % 5, ["new", "open", "done"]).alias("enum_label"),
        values.set_labels(n % 8, ["r", "w", "x"]).alias("set_labels"),
        values.unsigned(-(n % 100), "tinyint").alias("u8"),
        values.unsigned(-(n % 100), "bigint").cast("string").alias("u64"),
        values.signed_time((n - 500) * 100_000).alias("time_text"),
        values.small_boolean((n % 3).cast("string")).alias("flag"),
        values.without_zone(F.concat(F.lit("10:00:0"), (n % 10).cast("string"), F.lit("+08:30"))).alias("plain_time"),
    )


def dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose amount isn't a number, with the reason."""
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    x = table(spark, sf_dir, "events").select("event_id", text.alias("raw"))
    return x.where(F.col("raw").try_cast("decimal(20,2)").isNull()).withColumn("reason", F.lit("not a number: raw"))


def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the log's keys as of the middle of its positions."""
    log = change_log(spark, sf_dir)
    low, high = log.agg(F.min("seqno"), F.max("seqno")).first()
    return log.where(F.col("seqno") <= ((low or 0) + (high or 0)) // 2).groupBy("pk").agg(F.max("seqno").alias("seqno"), F.max_by("op", "seqno").alias("op"))


def row_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer")
    names = ["c_custkey", "c_name", "c_acctbal"]
    kinds = dict(x.dtypes)
    size = values.row_bytes(*[F.col(c) for c in names], kinds=[kinds[c] for c in names])
    return x.groupBy("c_mktsegment").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))


def _person(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.concat(F.lit("13"), F.lpad(key, 9, "0")).alias("phone"), F.concat(F.lit("11010119"), F.lpad(key, 9, "0"), F.lit("X")).alias("id_card"),
        F.concat(F.lit("u"), key, F.lit("@mail"), (F.col("c_custkey") % 7).cast("string"), F.lit(".example.com")).alias("email"), F.concat(F.lit("6222"), F.lpad(key, 13, "0")).alias("card"),
    )


def _mask(column: str, rule: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _person(spark, sf_dir).select("c_custkey", masking.masked(column, F.col(column), {column: rule}).alias("masked"))

    return query


def mask_auto_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _person(spark, sf_dir)
    return x.select("c_custkey", *[masking.masked(c, F.col(c), {}).alias(c) for c in ("c_name", "phone", "id_card", "email", "card")])


#: Statement, with {n} for the event's number: class, kind, conflict key, what a schema tool's statement becomes, decision in scope db1.
STATEMENTS = [
    ("INSERT INTO db1.orders (v, id) VALUES (concat('a,', f({n}, 2)), {n})", "DML", "INSERT", "db1.orders:{n}", "PASS", "NONE"),
    ("INSERT INTO db1.orders (id, v) VALUES ({n}, 1), (7, 2)", "DML", "INSERT", "db1.orders:*", "PASS", "NONE"),
    ("update `db2`.`users` set v = 'where id = 5' where id = '0{n}'", "DML", "UPDATE", "db2.users:{n}", "PASS", "NONE"),
    ("UPDATE users SET v = 1 WHERE id = {n} OR id = 2", "DML", "UPDATE", "users:*", "PASS", "NONE"),
    ("UPDATE users SET id = 1 WHERE id = {n}", "DML", "UPDATE", "users:*", "PASS", "NONE"),
    ("/* c */ DELETE FROM orders WHERE (a = 1 OR b = 2) AND id = '{n}' -- and id = 1", "DML", "DELETE", "orders:{n}", "PASS", "NONE"),
    ("DELETE a FROM a JOIN b ON a.x = b.x WHERE a.id = {n}", "DML", "DELETE", "*", "PASS", "NONE"),
    ("USE db1; delete from t where ID = {n};", "DML", "DELETE", "db1.t:{n}", "PASS", "NONE"),
    ("CREATE TABLE db1._orders_gho (id INT, n{n} INT)", "DDL", "CREATE_TABLE", "db1._orders_gho:*", "ALTER", "APPLY"),
    ("ALTER TABLE db1._orders_gho ADD COLUMN n{n} INT", "DDL", "ALTER_TABLE", "db1._orders_gho:*", "SKIP", "APPLY"),
    ("RENAME TABLE db1.orders TO db1._orders_del, db1._orders_gho TO db1.orders", "DDL", "RENAME_TABLE", "db1.orders:*", "SKIP", "APPLY"),
    ("DROP TABLE IF EXISTS _orders_del", "DDL", "DROP_TABLE", "_orders_del:*", "SKIP", "SKIP"),
    ("/*!50003 CREATE UNIQUE INDEX i{n} ON db1.t (a(10)) */", "DDL", "CREATE_INDEX", "db1.t:*", "PASS", "APPLY"),
    ("DROP INDEX i{n} ON db2.t", "DDL", "DROP_INDEX", "db2.t:*", "PASS", "SKIP"),
    ("CREATE OR REPLACE DEFINER=`r`@`%` SQL SECURITY INVOKER VIEW db1.v{n} AS SELECT 1", "DDL", "CREATE_VIEW", "db1.v{n}:*", "PASS", "APPLY"),
    ("CREATE DATABASE IF NOT EXISTS db1", "DDL", "CREATE_DATABASE", "", "PASS", "APPLY"),
    ("DROP DATABASE db1", "DDL", "DROP_DATABASE", "", "PASS", "MANUAL"),
    ("CREATE TRIGGER g{n} BEFORE INSERT ON db1.t FOR EACH ROW SET @a = 1", "DDL", "CREATE_TRIGGER", "db1.t:*", "PASS", "DEFER"),
    ("CREATE DEFINER=r@localhost PROCEDURE db1.p{n}() BEGIN DELETE FROM x; END", "DDL", "CREATE_ROUTINE", "db1.p{n}:*", "PASS", "APPLY"),
    ("COMMIT", "TRANSACTION", "COMMIT", "", "PASS", "NONE"), ("XA END 'x{n}'", "TRANSACTION", "XA", "", "PASS", "NONE"),
    ("grant select on *.* to u{n}", "DDL", "ACCOUNT", "", "PASS", "SKIP"), ("SET @x = 'DROP TABLE db1.t{n}'", "OTHER", "OTHER", "", "PASS", "NONE"),
]


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*[F.lit(s[0]) for s in STATEMENTS]), (F.col("event_id") % len(STATEMENTS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.replace(text, F.lit("{n}"), F.col("event_id").cast("string")).alias("sql"))


def sql_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, sub = statements.classify(F.col("sql"))
    return _statements(spark, sf_dir).select("event_id", kind.alias("kind"), sub.alias("sub"))


def sql_conflict_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(spark, sf_dir).select("event_id", statements.conflict_key(F.col("sql")).alias("conflict_key"))


def online_ddl_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(spark, sf_dir).select("event_id", statements.online_change(F.col("sql")).alias("action"))


def ddl_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, sub = statements.classify(F.col("sql"))
    db, _ = statements.table_of(F.col("sql"))
    return _statements(spark, sf_dir).select("event_id", statements.ddl_decision(kind, sub, "AUTO_APPLY", db == "db1").alias("decision"))


QUERIES = {
    f.__name__: f
    for f in (
        filter_exclude_null_safe, column_rename, column_extra_custom, schema_filter, event_type_filter, table_rename, enrich_table_metadata, keyset_page, update_minimize,
        document_transform, case_map, value_decode, dead_letter, snapshot_as_of, row_size, mask_auto_detect, sql_classify, sql_conflict_key, online_ddl_action, ddl_decision,
    )
} | {
    "mask_phone": _mask("phone", "phone"), "mask_id_card": _mask("id_card", "id_card"), "mask_email": _mask("email", "email"), "mask_bank_card": _mask("card", "bank_card"),
    "mask_full": _mask("c_name", "full"), "mask_partial": _mask("c_name", "partial"), "mask_hash": _mask("email", "hash"),
}

_OF = lambda i: f"replace({[s[i] for s in STATEMENTS]!r}[event_id % {len(STATEMENTS)} + 1], '{{n}}', event_id::VARCHAR)"
_PERSON = """WITH p AS (SELECT c_custkey, c_name, '13' || lpad(c_custkey::VARCHAR, 9, '0') AS phone, '11010119' || lpad(c_custkey::VARCHAR, 9, '0') || 'X' AS id_card,
  'u' || c_custkey || '@mail' || (c_custkey % 7) || '.example.com' AS email, '6222' || lpad(c_custkey::VARCHAR, 13, '0') AS card FROM customer)"""
_PHONE = "substr(phone, 1, 3) || '****' || right(phone, 4)"
_IDCARD = "substr(id_card, 1, 6) || repeat('*', (length(id_card) - 10)::INT) || right(id_card, 4)"
_CARD = "substr(card, 1, 4) || repeat('*', (length(card) - 8)::INT) || right(card, 4)"
_EMAIL = "substr(email, 1, 1) || '***' || substr(email, instr(email, '@'))"
_DB = "'db' || (user_id % 5)"

SQL = {
    "filter_exclude_null_safe": "SELECT * FROM (SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS status FROM orders) WHERE NOT coalesce(o_totalprice > 300000, false) AND NOT coalesce(status = 'F', false)",
    "column_rename": "SELECT o_orderkey, o_custkey AS customer, o_orderstatus AS status FROM orders",
    "column_extra_custom": "SELECT n_nationkey, n_name, 'sales' AS source_db, 'b1' AS batch FROM nation",
    "schema_filter": f"SELECT event_id, {_DB} AS db, event_type AS tbl FROM events WHERE (event_type LIKE 'c%' OR event_type = 'view') AND user_id % 5 <> 3",
    "event_type_filter": "SELECT event_id, event_type FROM events WHERE event_type NOT LIKE '%sign%' AND (event_type LIKE '%i%' OR event_type LIKE '%purchase%')",
    "table_rename": f"""SELECT event_id, CASE WHEN {_DB} = 'db1' AND event_type = 'click' THEN 'dw1.clicks' WHEN {_DB} = 'db2' AND event_type = 'view' THEN 'db2.views2'
        WHEN event_type = 'click' THEN {_DB} || '.all_clicks' WHEN event_type = 'error' THEN 'ops.errors' ELSE {_DB} || '.' || event_type END AS target FROM events""",
    "enrich_table_metadata": "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "keyset_page": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 1000",
    "update_minimize": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> o_custkey % 2 THEN 'half' ELSE '' END AS changed, CASE WHEN o_orderkey % 2 <> o_custkey % 2 THEN (o_custkey % 2)::VARCHAR END AS half FROM orders",
    "document_transform": "SELECT event_id, json_extract_string(props, '$.k') AS renamed, 'events' AS origin FROM events WHERE NOT coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT) < 20, false)",
    "case_map": f"SELECT event_id, upper({_DB}) AS db, lower(event_type) AS tbl FROM events",
    "value_decode": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'new' WHEN 2 THEN 'open' WHEN 3 THEN 'done' END AS enum_label,
        concat_ws(',', CASE WHEN event_id & 1 <> 0 THEN 'r' END, CASE WHEN event_id & 2 <> 0 THEN 'w' END, CASE WHEN event_id & 4 <> 0 THEN 'x' END) AS set_labels,
        CASE WHEN event_id % 100 = 0 THEN 0 ELSE 256 - event_id % 100 END AS u8,
        CASE WHEN event_id % 100 = 0 THEN '0' ELSE (18446744073709551616::HUGEINT - event_id % 100)::VARCHAR END AS u64,
        CASE WHEN event_id < 500 THEN '-' ELSE '' END || CASE WHEN abs(event_id - 500) * 100 // 3600 < 10 THEN '0' ELSE '' END || (abs(event_id - 500) * 100 // 3600) || ':' ||
          lpad((abs(event_id - 500) * 100 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((abs(event_id - 500) * 100 % 60)::VARCHAR, 2, '0') AS time_text,
        CASE event_id % 3 WHEN 1 THEN true WHEN 0 THEN false END AS flag, '10:00:0' || (event_id % 10) AS plain_time FROM events""",
    "dead_letter": "SELECT event_id, 'x' || event_id AS raw, 'not a number: raw' AS reason FROM events WHERE event_id % 10 = 0",
    "snapshot_as_of": f"WITH {LOG} SELECT pk, max(seqno) AS seqno, arg_max(op, seqno) AS op FROM log WHERE seqno <= (SELECT (min(seqno) + max(seqno)) // 2 FROM log) GROUP BY pk",
    "row_size": "SELECT c_mktsegment, sum(8 + 3 * length(c_name) + 8)::BIGINT AS bytes, count(*) AS rows FROM customer GROUP BY c_mktsegment",
    "mask_phone": f"{_PERSON} SELECT c_custkey, {_PHONE} AS masked FROM p",
    "mask_id_card": f"{_PERSON} SELECT c_custkey, {_IDCARD} AS masked FROM p",
    "mask_email": f"{_PERSON} SELECT c_custkey, {_EMAIL} AS masked FROM p",
    "mask_bank_card": f"{_PERSON} SELECT c_custkey, {_CARD} AS masked FROM p",
    "mask_full": f"{_PERSON} SELECT c_custkey, repeat('*', least(length(c_name), 8)::INT) AS masked FROM p",
    "mask_partial": f"{_PERSON} SELECT c_custkey, substr(c_name, 1, 1) || repeat('*', (length(c_name) - 2)::INT) || right(c_name, 1) AS masked FROM p",
    "mask_hash": f"{_PERSON} SELECT c_custkey, sha256(email) AS masked FROM p",
    "mask_auto_detect": f"{_PERSON} SELECT c_custkey, c_name, {_PHONE} AS phone, {_IDCARD} AS id_card, {_EMAIL} AS email, {_CARD} AS card FROM p",
    "sql_classify": f"SELECT event_id, {_OF(1)} AS kind, {_OF(2)} AS sub FROM events",
    "sql_conflict_key": f"SELECT event_id, {_OF(3)} AS conflict_key FROM events",
    "online_ddl_action": f"SELECT event_id, {_OF(4)} AS action FROM events",
    "ddl_decision": f"SELECT event_id, {_OF(5)} AS decision FROM events",
}
