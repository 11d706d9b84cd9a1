"""Schema statements, change messages and configured routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ddl, definitions, statements
from ..operators import changelog, conflicts, metrics, precheck, route_config
from ..sources import messages
from .inputs import LOG, change_log, dealt, epoch_ms, table


def _created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CREATE TABLE of MySQL for every part, with its size in a column, its name in a literal."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("CREATE TABLE `shop`.`t"), key, F.lit("` (`id` BIGINT UNSIGNED NOT NULL AUTO_INCREMENT, `n` INT(11), `flag` TINYINT(1), `name` VARCHAR("), size,
        F.lit(") DEFAULT 'int `x` "), key, F.lit("', `at` DATETIME(6) ON UPDATE CURRENT_TIMESTAMP, PRIMARY KEY (`id`)) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4"),
    )
    return dealt(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", "p_size", text.alias("sql"))


def ddl_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _created(spark, sf_dir).select("p_partkey", ddl.translated(F.col("sql"), "mysql", "pg").alias("sql"))


def ddl_translate_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('CREATE TABLE "t'), n, F.lit('" ("id" bigserial, "v" jsonb, "at" timestamptz, "tags" text[])')))
    text = text.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('ALTER TABLE "t'), n, F.lit('" ALTER COLUMN "v" TYPE boolean'))).otherwise(F.concat(F.lit("CREATE ROLE r"), n))
    return dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.coalesce(ddl.translated(text, "pg", "mysql"), F.lit("by hand")).alias("sql"))


def ddl_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("INSERT INTO `shop`.orders SELECT orders, 'from shop.orders' FROM users JOIN shop.users ON users.id = "), n)
    return dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", ddl.renamed(text, {"shop.orders": "dw.orders_all", "users": "people", "shop.users": "dw.people"}).alias("sql"))


def ddl_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _created(spark, sf_dir).select("p_partkey", ddl.merged_table(F.regexp_replace("sql", r"\) ENGINE.*$", ")"), ["_src_db", "_src_table"]).alias("sql"))


def ddl_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard = F.concat(F.lit("`dw`.`part_"), F.pmod("p_partkey", F.lit(4)).cast("string"), F.lit("`"))
    return _created(spark, sf_dir).select("p_partkey", ddl.split_table(F.col("sql"), shard).alias("sql"))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog's columns: four for the table of every part, with sizes and defaults of its own."""
    x = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.posexplode(F.array(*map(F.lit, ("id", "name", "flag", "at")))).alias("position", "name"))
    size, place = F.col("p_size").cast("string"), F.col("position")
    kind = F.when(place == 0, "bigint(20) unsigned").when(place == 1, F.concat(F.lit("varchar("), size, F.lit(")"))).when(place == 2, "tinyint(1)").otherwise("datetime(6)")
    default = F.when(place == 1, F.concat(F.lit("it's "), size)).when(place == 2, (F.col("p_size") % 2).cast("string")).when(place == 3, "CURRENT_TIMESTAMP(6)")
    name = F.concat(F.lit("shop.t"), F.col("p_partkey").cast("string")).alias("table")
    return x.select(name, "position", "name", kind.alias("type"), (place == 1).alias("nullable"), default.alias("default"), (place == 0).alias("auto"), F.when(place == 0, 1).alias("key"))


def column_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = definitions.column_definition("mysql", "pg", F.col("type"), F.col("nullable"), F.col("default"), F.col("auto"))
    return _columns(spark, sf_dir).select("table", "name", said.alias("definition"))


def table_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions.table_definitions(_columns(spark, sf_dir), "mysql", "pg", identity=True)


def sequence_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of PostgreSQL whose values come from sequences, casts, booleans and functions, for MySQL."""
    n = F.col("event_id") % 6
    pick = lambda *texts: F.get(F.array(*map(F.lit, texts)), n.cast("int"))
    kind = pick("bigserial", "int4", "varchar(9)", "bool", "timestamptz", "jsonb")
    default = F.when(n == 2, F.concat(F.lit("'"), F.col("event_type"), F.lit("'::character varying"))).otherwise(pick(None, "nextval('s'::regclass)", "", "true", "now()", "'{}'::jsonb"))
    return table(spark, sf_dir, "events").select("event_id", definitions.column_definition("pg", "mysql", kind, n % 2 == 0, default).alias("definition"))


def ddl_subtype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verbs = F.array(*map(F.lit, ("CREATE TABLE t", "ALTER TABLE t", "DROP TABLE t", "TRUNCATE TABLE t", "INSERT INTO t", "RENAME TABLE t", "CREATE INDEX i ON t")))
    x = table(spark, sf_dir, "events").select(F.concat(F.get(verbs, (F.col("event_id") % 7).cast("int")), F.col("event_id").cast("string")).alias("sql"))
    kind, sub = statements.classify(F.col("sql"))
    return x.select(kind.alias("kind"), sub.alias("sub")).where("kind = 'DDL'").groupBy("sub").agg(F.count("*").alias("n"))


def _canal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of every event: updates of one row with what it was, inserts of two, deletes, heartbeats, and broken text."""
    n, user = F.col("event_id"), F.col("user_id")
    row = lambda v: F.create_map(F.lit("id"), user.cast("string"), F.lit("v"), v.cast("string"))
    data = F.when(n % 5 == 0, F.array(row(n), row(n + 1))).otherwise(F.array(row(n)))
    old = F.when(n % 5 == 1, F.array(F.create_map(F.lit("v"), (n - 1).cast("string"))))
    kind = F.get(F.array(*map(F.lit, ("INSERT", "update", "DELETE", "TIDB_WATERMARK", "QUERY"))), (n % 5).cast("int"))
    body = F.to_json(F.struct(
        kind.alias("type"), (n % 5 == 4).alias("isDdl"), F.lit("app").alias("database"), F.col("event_type").alias("table"), epoch_ms(F.col("ts")).alias("es"), data.alias("data"), old.alias("old"),
        F.when(n % 2 == 0, F.struct(F.shiftleft(epoch_ms(F.col("ts")) + 5, messages.TSO_SHIFT).alias("commitTs"))).alias("_tidb"),
    ))
    return table(spark, sf_dir, "events").select("event_id", F.when(n % 11 == 0, F.lit("{broken")).otherwise(body).alias("value"))


def canal_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = messages.canal_changes(messages.parse_canal(_canal(spark, sf_dir)))
    of = lambda m, k: F.coalesce(F.element_at(m, k), F.lit("-"))
    return x.select("event_id", "table", "op", "row", "source_ts", of("after", "v").alias("v_after"), of("before", "v").alias("v_before"), of("before", "id").alias("id_before"))


def canal_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.parse_canal(_canal(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


def oplog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    op = F.get(F.array(*map(F.lit, "iudnc")), (n % 5).cast("int"))
    doc = F.struct(F.struct(F.col("user_id").cast("string").alias("$oid")).alias("_id"), F.col("event_type").alias("kind"))
    body = F.to_json(F.struct(op.alias("op"), F.concat(F.lit("app."), F.col("event_type"), F.lit(".log")).alias("ns"), F.struct((n * 2).alias("t"), (n % 3).alias("i")).alias("ts"), doc.alias("o")))
    return messages.parse_oplog(table(spark, sf_dir, "events").select("event_id", body.alias("value"))).select("event_id", "database", "collection", "op", "position", "key")


def op_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("insert", "UPDATE", "Delete", "COMMIT", "ROTATE", "HEARTBEAT")))
    x = table(spark, sf_dir, "events").select("event_id", messages.operation(F.get(kinds, (F.col("event_id") % 6).cast("int"))).alias("op"))
    return x.where("op IS NOT NULL")


ROUTES = {
    "route.mode": "SPLIT", "route.split.1.match": "app.ord*", "route.split.1.shard.key": "o_custkey", "route.split.1.count": "8", "route.split.1.target.db": "dw_${shard/4}",
    "route.split.1.target.table": "orders_${shard}", "route.split.1.target.group": "g1", "route.node.g1.0.host": "a", "route.node.g1.1.host": "b",
}


def route_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return route_config.routed(x, "app.orders", route_config.parse_routes(ROUTES)).select("o_orderkey", "target_db", "target_table", "target_node")


MERGES = {"route.mode": "MERGE", "route.merge.1.match": "shop*.customer", "route.merge.1.target": "dw.parties"}


def compare_routed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a source table, and of all targets that its rule lists."""
    routes = route_config.parse_routes(ROUTES)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    targets = spark.createDataFrame([t[:2] for t in routes.compare_targets("n1", "app.orders")], "target_db string, target_table string")
    held = route_config.routed(orders, "app.orders", routes).groupBy("target_db", "target_table").agg(F.count("*").alias("rows"))
    return targets.join(held, ["target_db", "target_table"], "left").na.fill(0, ["rows"])


def merge_row_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer")
    return x.select("c_custkey", route_config.tagged_key([F.col("c_custkey")], [F.lit("n1"), F.lit("shop"), F.lit("customer")], "|").alias("row_key"))


def conflict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .changes import _contended

    return conflicts.conflict_log(_contended(spark, sf_dir), ["pk"]).select("pk", "seqno", "incoming_node", "stored_node", "incoming_ts", "stored_ts", "winner")


def column_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an event whose values don't fit its columns: they keep no names, and are told."""
    n = F.col("event_id")
    after = F.when(n % 5 == 0, F.array(n.cast("string"))).otherwise(F.array(n.cast("string"), F.lit("v")))
    x = table(spark, sf_dir, "events").select(n.alias("seqno"), n.cast("string").alias("event_id"), F.array(after).alias("after"), F.array(after).alias("before"))
    return changelog.explode_rows(x, "after", "before", ["id", "v"]).where("after IS NULL").select("seqno", "event_id")


def recovery_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(epoch_ms(F.col("ts"))).alias("at"))
    return x.select("user_id", F.coalesce(metrics.recovery_time(F.col("at") + (F.col("user_id") % 7 - 2) * 1000, F.col("at")), F.lit(-1)).alias("rto_ms"))


def tables_by_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select(F.col("event_type").alias("tbl"), F.pmod(F.col("event_id") * 7919, F.lit(6000)).alias("ms"))
    return metrics.slowest(metrics.latency_percentiles(x, ["tbl"], "ms", [95]).select("tbl", "avg_ms"), "tbl")


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.page(table(spark, sf_dir, "events").select("event_id", "event_type"), [F.col("event_id").desc()], 3, 50)


def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_id", epoch_ms(F.col("ts")).alias("at_ms"))
    return metrics.kept_history(x, "at_ms", x.agg(F.max("at_ms")).first()[0] or 0, 7)


def task_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 13 == 0).alias("deleted"))
    return metrics.task_search(x, ["o_orderpriority"], "HIGH", o_orderstatus="O").select("o_orderkey", "o_orderpriority")


def settings_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("db.Password = p"), n)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("api_token: "), n)).otherwise(F.concat(F.lit("host="), n))
    return table(spark, sf_dir, "customer").select("c_custkey", metrics.masked_settings(line).alias("line"))


def tables_without_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a catalog, here the customers' numbers, that no primary key is listed for."""
    tables = table(spark, sf_dir, "customer").select(F.lit("app").alias("db"), F.col("c_custkey").cast("string").alias("table"))
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lit("app").alias("db"), F.col("o_custkey").cast("string").alias("table"), F.lit("PRIMARY").alias("kind"))
    return precheck.without_key(tables, keys).select(F.col("table").cast("bigint").alias("table_id"))


def _catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A catalog of a table for each customer, in databases by nation, and a selection of tables and whole databases."""
    n, db = F.col("c_custkey"), F.concat(F.lit("db"), F.col("c_nationkey").cast("string"))
    name = F.concat(F.lit("T"), n.cast("string"))
    x = table(spark, sf_dir, "customer").select(n, "c_nationkey", db.alias("db"), name.alias("table"))
    tables = x.where("c_custkey % 7 <> 0 AND c_nationkey <> 24")
    columns = tables.select("db", "table", "c_custkey", F.explode(F.array(F.lit("ID"), F.lit("Code"))).alias("column")).withColumn("nullable", (F.col("column") == "Code") & (F.col("c_custkey") % 4 == 0))
    primary = tables.where("c_custkey % 3 <> 0").select("db", "table", F.lit("pk").alias("key"), F.lit("PRIMARY").alias("kind"), F.lit("id").alias("column"))
    unique = tables.where("c_custkey % 3 = 0 AND c_custkey % 2 = 0").select("db", "table", F.lit("u").alias("key"), F.lit("UNIQUE").alias("kind"), F.lit("code").alias("column"))
    lower = F.lower("table")
    return {
        "selection": x.where("c_nationkey >= 3 AND c_custkey % 5 <> 0").select("db", lower.alias("table"), F.lit("dw").alias("target_db"), F.concat(F.lit("t"), (n % 1000).cast("string")).alias("target_table"))
        .union(x.where("c_nationkey < 3").select("db", F.lit(None).cast("string"), "db", F.lit(None).cast("string")).distinct()),
        "tables": tables.select("db", "table"), "columns": columns.select("db", "table", "column", "nullable"), "keys": primary.union(unique),
        "parents": tables.where("c_custkey % 11 = 0").select("db", "table", F.col("db").alias("parent_db"), F.concat(F.lit("T"), (n + 5).cast("string")).alias("parent_table")),
        "targets": table(spark, sf_dir, "supplier").select(F.lit("dw").alias("db"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("table")),
        "used": tables.where("c_custkey % 13 = 0").select("db", "table", F.when(n % 2 == 0, "code").otherwise("gone").alias("column")),
    }


def schema_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each check finds in a catalog, for a capture by rows and for one by keys."""
    catalog = _catalog(spark, sf_dir)
    by = lambda capture: precheck.precheck(**catalog, capture=capture).withColumn("capture", F.lit(capture))
    return by("rows").unionByName(by("keys").where("check = 'keys'"))


def document_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of a document store in bulks of a bounded number, each for one collection."""
    log = change_log(spark, sf_dir).select("seqno", "event_type", "op")
    return log.groupBy("event_type", F.floor(F.col("seqno") / 500).alias("bulk")).agg(F.count("*").alias("writes"), F.count_if(F.col("op") == "d").alias("deletes"))


QUERIES = {
    f.__name__: f
    for f in (
        ddl_translate, ddl_translate_back, ddl_rename, ddl_merge, ddl_split, column_definitions, table_definitions, sequence_definitions, ddl_subtype_counts, canal_changes, canal_kinds, oplog_changes, op_mapping, route_configured, compare_routed_targets, merge_row_key,
        conflict_log, column_count_mismatch, recovery_time, tables_by_latency, history_page, history_retention, task_search, settings_masked, tables_without_key, schema_precheck, document_bulk,
    )
}

_MS = "(epoch_us(ts) // 1000)"
SQL = {
    "column_definitions": """SELECT 'shop.t' || p_partkey AS "table", name, CASE name WHEN 'id' THEN 'NUMERIC(20,0) NOT NULL' WHEN 'name' THEN 'VARCHAR(' || p_size || ') DEFAULT ''it''''s ' || p_size || ''''
        WHEN 'flag' THEN 'BOOLEAN NOT NULL DEFAULT ' || CASE p_size % 2 WHEN 1 THEN 'TRUE' ELSE 'FALSE' END ELSE 'TIMESTAMP NOT NULL DEFAULT CURRENT_TIMESTAMP' END AS definition FROM part, (SELECT unnest(['id', 'name', 'flag', 'at']) AS name)""",
    "table_definitions": """SELECT 'shop.t' || p_partkey AS "table", 'CREATE TABLE IF NOT EXISTS "shop"."t' || p_partkey || '" ("id" NUMERIC(20,0) NOT NULL GENERATED BY DEFAULT AS IDENTITY, "name" VARCHAR(' || p_size || ') DEFAULT ''it''''s ' || p_size ||
        ''', "flag" BOOLEAN NOT NULL DEFAULT ' || CASE p_size % 2 WHEN 1 THEN 'TRUE' ELSE 'FALSE' END || ', "at" TIMESTAMP NOT NULL DEFAULT CURRENT_TIMESTAMP, PRIMARY KEY ("id"))' AS sql FROM part""",
    "sequence_definitions": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'BIGINT AUTO_INCREMENT' WHEN 1 THEN 'INT NOT NULL' WHEN 2 THEN 'VARCHAR(9) DEFAULT ''' || event_type || '''' WHEN 3 THEN 'TINYINT(1) NOT NULL DEFAULT 1'
        WHEN 4 THEN 'DATETIME DEFAULT CURRENT_TIMESTAMP' ELSE 'JSON NOT NULL DEFAULT (''{}'')' END AS definition FROM events""",
    "ddl_translate": """SELECT p_partkey, 'CREATE TABLE "shop"."t' || p_partkey || '" ("id" BIGSERIAL NOT NULL, "n" INTEGER, "flag" BOOLEAN, "name" VARCHAR(' || p_size || ') DEFAULT ''int `x` ' || p_partkey || ''', "at" TIMESTAMP(6), PRIMARY KEY ("id"))' AS sql FROM part""",
    "ddl_translate_back": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'CREATE TABLE `t' || p_partkey || '` (`id` BIGINT AUTO_INCREMENT, `v` JSON, `at` DATETIME, `tags` TEXT) ENGINE=InnoDB'
        WHEN 1 THEN 'ALTER TABLE `t' || p_partkey || '` MODIFY COLUMN `v` TINYINT(1)' ELSE 'by hand' END AS sql FROM part""",
    "ddl_rename": """SELECT p_partkey, 'INSERT INTO dw.orders_all SELECT orders, ''from shop.orders'' FROM people JOIN dw.people ON people.id = ' || p_partkey AS sql FROM part""",
    "ddl_merge": """SELECT p_partkey, 'CREATE TABLE `shop`.`t' || p_partkey || '` (`id` BIGINT UNSIGNED NOT NULL AUTO_INCREMENT, `n` INT(11), `flag` TINYINT(1), `name` VARCHAR(' || p_size || ') DEFAULT ''int `x` ' || p_partkey ||
        ''', `at` DATETIME(6) ON UPDATE CURRENT_TIMESTAMP, PRIMARY KEY (`id`, `_src_db`, `_src_table`), `_src_db` VARCHAR(64) NOT NULL DEFAULT '''', `_src_table` VARCHAR(64) NOT NULL DEFAULT '''')' AS sql FROM part""",
    "ddl_split": """SELECT p_partkey, 'CREATE TABLE `dw`.`part_' || (p_partkey % 4) || '` (`id` BIGINT UNSIGNED NOT NULL, `n` INT(11), `flag` TINYINT(1), `name` VARCHAR(' || p_size || ') DEFAULT ''int `x` ' || p_partkey ||
        ''', `at` DATETIME(6) ON UPDATE CURRENT_TIMESTAMP, PRIMARY KEY (`id`)) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4' AS sql FROM part""",
    "ddl_subtype_counts": """SELECT ['CREATE_TABLE', 'ALTER_TABLE', 'DROP_TABLE', 'TRUNCATE_TABLE', '', 'RENAME_TABLE', 'CREATE_INDEX'][event_id % 7 + 1] AS sub, count(*) AS n FROM events WHERE event_id % 7 <> 4 GROUP BY 1""",
    "canal_changes": f"""SELECT event_id, event_type AS "table", CASE event_id % 5 WHEN 0 THEN 'c' WHEN 1 THEN 'u' ELSE 'd' END AS op, r.i::INT AS row, {_MS} + CASE WHEN event_id % 2 = 0 THEN 5 ELSE 0 END AS source_ts,
        CASE WHEN event_id % 5 = 2 THEN '-' ELSE (event_id + r.i)::VARCHAR END AS v_after, CASE event_id % 5 WHEN 0 THEN '-' WHEN 1 THEN (event_id - 1)::VARCHAR ELSE event_id::VARCHAR END AS v_before,
        CASE WHEN event_id % 5 = 0 THEN '-' ELSE user_id::VARCHAR END AS id_before FROM events, range(2) AS r(i) WHERE event_id % 5 < 3 AND event_id % 11 <> 0 AND (r.i = 0 OR event_id % 5 = 0)""",
    "canal_kinds": "SELECT CASE WHEN event_id % 11 = 0 THEN 'BROKEN' WHEN event_id % 5 < 3 THEN 'ROW' WHEN event_id % 5 = 3 THEN 'HEARTBEAT' ELSE 'DDL' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "oplog_changes": """SELECT event_id, 'app' AS database, event_type || '.log' AS collection, ['c', 'u', 'd', '', 'x'][event_id % 5 + 1] AS op, (event_id * 2) || ':' || (event_id % 3) AS position, user_id::VARCHAR AS key FROM events WHERE event_id % 5 <> 3""",
    "op_mapping": "SELECT event_id, ['c', 'u', 'd'][event_id % 6 + 1] AS op FROM events WHERE event_id % 6 < 3",
    "route_configured": "SELECT o_orderkey, 'dw_' || (o_custkey % 8 // 4) AS target_db, 'orders_' || (o_custkey % 8) AS target_table, (o_custkey % 8 // 4)::INT AS target_node FROM orders",
    "compare_routed_targets": "SELECT 'dw_' || (s.i // 4) AS target_db, 'orders_' || s.i AS target_table, count(o_orderkey) AS rows FROM range(8) AS s(i) LEFT JOIN orders ON o_custkey % 8 = s.i GROUP BY s.i",
    "merge_row_key": "SELECT c_custkey, c_custkey || '|n1|shop|customer' AS row_key FROM customer",
    "conflict_log": f"""WITH {LOG}, c AS (SELECT seqno, pk, node, (date_diff('day', DATE '2020-01-01', source_ts::DATE) - seqno % 3)::BIGINT AS t FROM log),
        h AS (SELECT *, max(struct_pack(t := t, node := node)) OVER (PARTITION BY pk ORDER BY seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM c)
        SELECT pk, seqno, node AS incoming_node, held.node AS stored_node, t AS incoming_ts, held.t AS stored_ts, CASE WHEN t = held.t AND node > held.node THEN 'INCOMING' ELSE 'STORED' END AS winner FROM h WHERE node <> held.node AND t <= held.t""",
    "column_count_mismatch": "SELECT event_id AS seqno, event_id || '_0' AS event_id FROM events WHERE event_id % 5 = 0",
    "recovery_time": "SELECT user_id, CASE WHEN user_id % 7 < 2 THEN -1 ELSE (user_id % 7 - 2) * 1000 END AS rto_ms FROM events GROUP BY user_id",
    "tables_by_latency": "WITH t AS (SELECT event_type AS tbl, (sum((event_id * 7919) % 6000) // count(*))::BIGINT AS avg_ms FROM events GROUP BY 1) SELECT *, row_number() OVER (ORDER BY avg_ms DESC, tbl)::INT AS rank FROM t",
    "history_page": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50 OFFSET 150",
    "history_retention": f"SELECT event_id, {_MS} AS at_ms FROM events WHERE {_MS} >= (SELECT max({_MS}) FROM events) - 7 * 86400000",
    "task_search": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderstatus = 'O' AND o_orderpriority ILIKE '%high%'",
    "settings_masked": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'db.Password = ******' WHEN 1 THEN 'api_token: ******' ELSE 'host=' || c_custkey END AS line FROM customer",
    "tables_without_key": "SELECT c_custkey AS table_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "schema_precheck": """WITH x AS (SELECT c_custkey AS n, c_nationkey AS nation, 'db' || c_nationkey AS db, 'T' || c_custkey AS name FROM customer), t AS (SELECT * FROM x WHERE n % 7 <> 0 AND nation <> 24),
        c AS (SELECT n, db, 't' || n AS name, 'dw' AS tdb, 't' || (n % 1000) AS tname FROM t WHERE nation >= 3 AND n % 5 <> 0 UNION ALL SELECT n, db, name, db, name FROM t WHERE nation < 3),
        f AS (SELECT 'source_objects' AS "check", 'FAIL' AS worst, 'rows' AS capture, o FROM (SELECT DISTINCT db AS o FROM x WHERE (nation < 3 OR n % 5 <> 0) AND db NOT IN (SELECT db FROM t)
                UNION ALL SELECT db || '.t' || n FROM x WHERE nation >= 3 AND n % 5 <> 0 AND db IN (SELECT db FROM t) AND n NOT IN (SELECT n FROM t))
              UNION ALL SELECT 'keys', 'WARNING', 'rows', db || '.' || name FROM c WHERE n % 3 = 0
              UNION ALL SELECT 'keys', 'FAIL', 'keys', db || '.' || name FROM c WHERE n % 3 = 0 AND (n % 2 <> 0 OR n % 4 = 0)
              UNION ALL SELECT 'rule_columns', 'FAIL', 'rows', db || '.' || name || '.gone' FROM t WHERE n % 13 = 0 AND n % 2 <> 0
              UNION ALL SELECT 'parents', 'WARNING', 'rows', db || '.' || name || ' -> ' || db || '.T' || (n + 5) FROM t WHERE n % 11 = 0 AND n IN (SELECT n FROM c) AND nation >= 3
                AND NOT EXISTS (SELECT 1 FROM c WHERE c.n = t.n + 5 AND c.db = t.db)
              UNION ALL SELECT DISTINCT 'target_names', 'WARNING', 'rows', 'dw.' || tname FROM c WHERE tdb = 'dw' AND (lower(tname) IN (SELECT 't' || s_suppkey FROM supplier) OR (SELECT count(*) FROM c d WHERE d.tdb = 'dw' AND d.tname = c.tname) > 1)),
        k AS (SELECT * FROM (VALUES ('source_objects', 'rows'), ('keys', 'rows'), ('keys', 'keys'), ('rule_columns', 'rows'), ('parents', 'rows'), ('target_names', 'rows')) v("check", capture)),
        r AS (SELECT *, row_number() OVER (PARTITION BY "check", capture ORDER BY o) AS i FROM f)
        SELECT k."check", k.capture, coalesce(max(worst), 'PASS') AS status, count(o) AS n, coalesce(string_agg(CASE WHEN i <= 20 THEN o END, ', ' ORDER BY o), '') AS objects FROM k LEFT JOIN r ON r."check" = k."check" AND r.capture = k.capture GROUP BY ALL""",
    "document_bulk": f"WITH {LOG} SELECT event_type, seqno // 500 AS bulk, count(*) AS writes, count(*) FILTER (WHERE op = 'd') AS deletes FROM log GROUP BY ALL",
}
