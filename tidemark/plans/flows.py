"""Through sources and sinks and back: files, shards, messages, rejects and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..functions import columns, statements, values
from ..operators import changelog, metrics, route_config, routing
from ..sources import readers, sinks
from ..streaming import apply
from .changes import SQL as CHANGES
from .changes import _contended
from .inputs import LOG, change_log, epoch_ms, table
from .rows import STATEMENTS


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def filtered_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes become where a row filter excludes their image before or after."""
    log = change_log(spark, sf_dir)
    kind = changelog.filter_transition(F.col("op"), F.col("seqno") % 3 == 0, F.col("seqno") % 4 == 0)
    return log.select("seqno", kind.alias("op")).where("op IS NOT NULL")


def statement_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose columns a statement may change."""
    text = F.replace(F.get(F.array(*[F.lit(s[0]) for s in STATEMENTS]), (F.col("event_id") % len(STATEMENTS)).cast("int")), F.lit("{n}"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(statements.affected_tables(text, F.lit("cur")), ",").alias("tables"))


def typed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over a time, a number and a text, each compared by its column's type."""
    return columns.keep_rows(table(spark, sf_dir, "orders"), "o_orderdate|<|1995-01-01; o_totalprice|>=|200000.5; O_ORDERPRIORITY|=|1-URGENT; o_custkey|<=|10").select("o_orderkey")


def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured filters by priority, and the rows that each passed on."""

    def rules(df, of: str):
        return columns.keep_rows(df, of)

    def kinds(df, skip: list):
        return df.where(columns.event_wanted(F.col("event_type"), skip, []))

    settings = {"filters": "late,first", "filter.late.class": "rules", "filter.late.of": "event_id|<|50", "filter.first.class": "kinds", "filter.first.skip": "error, view", "filter.first.priority": "1"}
    out, told = columns.chained(table(spark, sf_dir, "events").select("event_id", "event_type"), columns.configured_filters(settings, {"rules": rules, "kinds": kinds}))
    out.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(name, o.get["passed"]) for name, o in told.items()], "filter string, passed long")


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 == 0, "d").otherwise("u").alias("op"))
    return sinks.index_requests(x, "Shop", "Customer", ["c_custkey"])


def change_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    value = F.to_json(F.struct("op", F.struct(F.col("pk").alias("id"), F.col("event_type").alias("kind")).alias("row")))
    return sinks.as_messages(changelog.topic("TABLE", "sync", "t1", F.lit("app"), F.col("event_type")), changelog.message_key("app", "users", [F.col("pk"), F.col("seqno")], F.lit("")), value, log)


def shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written to a folder for each shard, and read back."""
    path = _folder(spark, "shards")
    rule = routing.SplitRule("o_custkey", "hash_mod", count=6, database="dw_${shard/3}", table="orders_${shard}")
    sinks.write_shards(routing.split_route(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), rule), path)
    return spark.read.parquet(path).groupBy("target_db", "target_table").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


def route_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table that no rule matches stay where they are."""
    routes = route_config.parse_routes({"route.mode": "SPLIT", "route.split.1.match": "app.ord*", "route.split.1.shard.key": "c_custkey", "route.split.1.count": "8", "route.split.1.target.db": "dw", "route.split.1.target.table": "o_${shard}"})
    x = table(spark, sf_dir, "customer").select("c_custkey")
    return route_config.routed(x, "app.customer", routes).select("c_custkey", "target_db", "target_table")


def fan_out_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch in two sinks, of which one is out of order for a third."""
    path = _folder(spark, "copies")

    def broken(df):
        df.select(F.raise_error(F.lit("no such sink"))).write.format("noop").mode("overwrite").save()

    done = sinks.fan_out(change_log(spark, sf_dir).select("seqno", "op"), {"all": lambda df: df.write.parquet(f"{path}/all"), "broken": broken, "deletes": lambda df: df.where("op = 'd'").write.parquet(f"{path}/deletes")})
    outcome = spark.createDataFrame([(k, v.split(":")[0]) for k, v in done.items()], "sink string, outcome string")
    rows = spark.read.parquet(f"{path}/all").agg(F.count("*").alias("rows")).withColumn("sink", F.lit("all")).unionByName(spark.read.parquet(f"{path}/deletes").agg(F.count("*").alias("rows")).withColumn("sink", F.lit("deletes")))
    return outcome.join(rows, "sink", "left").na.fill(-1, ["rows"])


def error_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).select("seqno", F.concat(F.lit("e"), F.col("seqno").cast("string")).alias("event_id"), (F.col("seqno") % 101 == 0).alias("failed"))
    good, aside = sinks.route_errors(log, "failed", ["e5", "e202"], [7], "DEAD_LETTER")
    return good.withColumn("reason", F.lit("applied")).unionByName(aside).groupBy("reason").agg(F.count("*").alias("n"), F.sum("seqno").alias("seqnos"))


def latency_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies written as files of tabs, read again, by level."""
    path, ms = _folder(spark, "latencies"), F.pmod(F.col("event_id") * 7919, F.lit(9000))
    at = epoch_ms(F.col("ts"))
    table(spark, sf_dir, "events").select(at + ms, at, ms, F.col("event_type")).write.csv(path, sep="\t")
    got = readers.read_latencies(spark, path)
    return got.groupBy(metrics.latency_level(F.col("latency_ms")).alias("level")).agg(F.count("*").alias("n"), F.max("latency_ms").alias("most"), F.count_if(F.col("applied_ts") - F.col("event_ts") != F.col("latency_ms")).alias("wrong"))


def captured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured lines of three fields; one that lacks a field keeps its text."""
    path, n = _folder(spark, "captured"), F.col("event_id").cast("string")
    whole = F.array_join(F.array(n, F.col("event_type"), F.col("user_id").cast("string")), readers.FIELD)
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 9 == 0, F.concat(n, F.lit(readers.FIELD), F.col("event_type"))).otherwise(whole).alias("value")).write.text(path)
    got = readers.read_captured(spark, path, ["id", "kind", "user"])
    return got.select(F.coalesce("id", F.lit("-")).alias("id"), F.coalesce("kind", F.lit("-")).alias("kind"), F.coalesce(F.replace("raw", F.lit(readers.FIELD), F.lit("|")), F.lit("-")).alias("raw"))


def log_from_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written log from behind its middle."""
    path, log = _folder(spark, "log"), change_log(spark, sf_dir).select("seqno", "op", "pk")
    log.repartitionByRange(4, "seqno").sortWithinPartitions("seqno").write.parquet(path)
    low, high = log.agg(F.min("seqno"), F.max("seqno")).first()
    return readers.read_log(spark, path, ((low or 0) + (high or 0)) // 2).groupBy("op").agg(F.count("*").alias("n"), F.min("seqno").alias("first_seqno"))


def load_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and estimated bytes of a load, told by the load itself."""
    x, told = sinks.load_statistics(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey", "o_orderstatus", "o_totalprice"])
    x.write.parquet(_folder(spark, "load"))
    return spark.createDataFrame([(told.get["rows"], told.get["bytes"])], "rows long, bytes long")


def binary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.when(n % 7 == 0, F.concat(F.lit("0x"), F.hex(n), F.lit("z"))).otherwise(F.concat(F.lit("0x"), F.lpad(F.hex(n), 6, "0")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.hex(values.hex_bytes(text)), F.lit("-")).alias("bytes"), F.hex(values.bit_bytes(n % 4096, 12)).alias("bits"))


def replayed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that comes as files out of order, a part of it twice, applied batch by batch to a keyed table."""
    path, log = _folder(spark, "stream"), change_log(spark, sf_dir).select("seqno", "pk", "op", "event_type")
    low, high = log.agg(F.min("seqno"), F.max("seqno")).first()
    low, high = low or 0, high or 0
    third = (high - low) // 3
    for a, b in ((low + third, low + 2 * third), (low, low + third + third // 2), (low + 2 * third, high)):
        log.where(F.col("seqno").between(a, b)).coalesce(2).write.mode("append").parquet(f"{path}/log")
    sink = sinks.KeyedTable(spark, f"{path}/table", ["pk"], 4)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/log")
    apply.apply_stream(stream, sink, f"{path}/checkpoint").awaitTermination()
    return apply.live_rows(sink).select("pk", "seqno", "event_type")


def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on a log that comes in two files, by keyed state."""
    path, log = _folder(spark, "decisions"), _contended(spark, sf_dir).select("pk", "seqno", "node", "source_ts")
    low, high = log.agg(F.min("seqno"), F.max("seqno")).first()
    middle = ((low or 0) + (high or 0)) // 2
    for part in (log.where(F.col("seqno") <= middle), log.where(F.col("seqno") > middle)):
        part.coalesce(1).write.mode("append").parquet(f"{path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
    said = apply.decide_stream(stream, "pk").writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    said.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("pk long, seqno long, decision string").parquet(f"{path}/out")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour of a stream that sends some of them twice, once no more are awaited."""
    path = _folder(spark, "windows")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seqno"), F.col("ts").cast("timestamp").alias("ts"))
    events.union(events.where("seqno % 10 = 0")).coalesce(2).write.parquet(f"{path}/log")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/log").withWatermark("ts", "10 minutes")
    counted = apply.throughput_stream(apply.first_of_each(stream, ["seqno"]), "ts", "1 hour").writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    counted.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("window_start timestamp, events long").parquet(f"{path}/out").select(F.unix_millis("window_start").alias("start_ms"), "events")


QUERIES = {f.__name__: f for f in (filtered_changes, statement_tables, typed_rules, filter_chain, index_lines, change_messages, shard_files, route_identity, fan_out_copies, error_policy, latency_files, captured_lines, log_from_position, load_statistics, binary_values, replayed_stream, stream_decisions, stream_windows)}

_TABLES = ["" for _ in STATEMENTS]
_TABLES[8] = _TABLES[9] = "db1._orders_gho"
_TABLES[10], _TABLES[11] = "db1.orders,db1._orders_del,db1._orders_gho,db1.orders", "cur._orders_del"
SQL = {
    "filtered_changes": f"""WITH {LOG}, x AS (SELECT seqno, op, seqno % 3 = 0 AS b, seqno % 4 = 0 AS a FROM log),
        y AS (SELECT seqno, CASE op WHEN 'u' THEN CASE WHEN a AND b THEN NULL WHEN a THEN 'd' WHEN b THEN 'c' ELSE 'u' END WHEN 'd' THEN CASE WHEN NOT b THEN 'd' END ELSE CASE WHEN NOT a THEN 'c' END END AS op FROM x) SELECT * FROM y WHERE op IS NOT NULL""",
    "statement_tables": f"SELECT event_id, {_TABLES!r}[event_id % {len(STATEMENTS)} + 1] AS tables FROM events",
    "typed_rules": "SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1995-01-01' OR o_totalprice >= 200000.5 OR o_orderpriority = '1-URGENT' OR o_custkey <= 10)",
    "filter_chain": "SELECT 'first' AS filter, count(*) AS passed FROM events WHERE event_type NOT IN ('error', 'view') UNION ALL SELECT 'late', count(*) FROM events WHERE event_type NOT IN ('error', 'view') AND event_id >= 50",
    "index_lines": r"""SELECT CASE WHEN c_custkey % 5 = 0 THEN '{"delete":{"_index":"shop_customer","_id":"' || c_custkey || '"}}'
        ELSE '{"index":{"_index":"shop_customer","_id":"' || c_custkey || '"}}' || chr(10) || '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' END AS value FROM customer""",
    "change_messages": f"""WITH {LOG} SELECT 'sync.t1.app.' || event_type AS topic, 'app.users.' || pk || '_' || seqno AS key, '{{"op":"' || op || '","row":{{"id":' || pk || ',"kind":"' || event_type || '"}}}}' AS value FROM log""",
    "shard_files": "SELECT 'dw_' || (o_custkey % 6 // 3) AS target_db, 'orders_' || (o_custkey % 6) AS target_table, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1, 2",
    "route_identity": "SELECT c_custkey, 'app' AS target_db, 'customer' AS target_table FROM customer",
    "fan_out_copies": f"WITH {LOG} SELECT 'all' AS sink, 'ok' AS outcome, count(*) AS rows FROM log UNION ALL SELECT 'broken', 'failed', -1 UNION ALL SELECT 'deletes', 'ok', count(*) FROM log WHERE op = 'd'",
    "error_policy": f"""WITH {LOG} SELECT CASE WHEN seqno IN (5, 202, 7) THEN 'skipped' WHEN seqno % 101 = 0 THEN 'failed' ELSE 'applied' END AS reason, count(*) AS n, sum(seqno)::BIGINT AS seqnos FROM log GROUP BY 1""",
    "latency_files": """WITH x AS (SELECT (event_id * 7919) % 9000 AS ms FROM events)
        SELECT CASE WHEN ms < 100 THEN 'EXCELLENT' WHEN ms < 500 THEN 'GOOD' WHEN ms < 1000 THEN 'NORMAL' WHEN ms < 5000 THEN 'WARNING' ELSE 'CRITICAL' END AS level, count(*) AS n, max(ms) AS most, 0::BIGINT AS wrong FROM x GROUP BY 1""",
    "captured_lines": "SELECT CASE WHEN event_id % 9 = 0 THEN '-' ELSE event_id::VARCHAR END AS id, CASE WHEN event_id % 9 = 0 THEN '-' ELSE event_type END AS kind, CASE WHEN event_id % 9 = 0 THEN event_id || '|' || event_type ELSE '-' END AS raw FROM events",
    "log_from_position": f"WITH {LOG} SELECT op, count(*) AS n, min(seqno) AS first_seqno FROM log WHERE seqno > (SELECT (min(seqno) + max(seqno)) // 2 FROM log) GROUP BY op",
    "load_statistics": "SELECT count(*) AS rows, sum(8 + 3 * length(o_orderstatus) + 8)::BIGINT AS bytes FROM orders",
    "binary_values": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '-' ELSE lpad(upper(to_hex(event_id)), 6, '0') END AS bytes, lpad(upper(to_hex(event_id % 4096)), 4, '0') AS bits FROM events",
    "replayed_stream": f"WITH {LOG} SELECT pk, max(seqno) AS seqno, arg_max(event_type, seqno) AS event_type FROM log GROUP BY pk HAVING arg_max(op, seqno) <> 'd'",
    "stream_decisions": CHANGES["conflict_lww_decisions"],
    "stream_windows": """WITH x AS (SELECT date_trunc('hour', ts) AS h, count(*) AS events FROM events GROUP BY 1)
        SELECT epoch_us(h) // 1000 AS start_ms, events FROM x WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
}
