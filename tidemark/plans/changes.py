"""Change logs: state, transactions, messages, conflicts and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changelog, conflicts, folds
from .inputs import LOG, change_log, epoch_ms, table


def cdc_apply_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.apply_latest(change_log(spark, sf_dir), ["pk"]).select("pk", "seqno", "op", "value")


def cdc_apply_update_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    return changelog.apply_latest(log, ["pk"], update_missing="ignore").select("pk", "seqno", "op")


def cdc_apply_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.apply_ignore(change_log(spark, sf_dir), ["pk"]).select("pk", "seqno", "value")


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    put = c.where("c_custkey % 10 = 0").withColumn("c_name", F.concat("c_name", F.lit("!"))).unionByName(c.where("c_custkey % 25 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    return changelog.upsert(c, put, ["c_custkey"])


def cdc_filter_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).withColumn("before_out", F.col("pk") % 4 == 0).withColumn("after_out", F.col("seqno") % 3 == 0)
    x = log.withColumn("becomes", changelog.filter_transition(F.col("op"), F.col("before_out"), F.col("after_out")))
    return x.where("becomes IS NOT NULL").select("seqno", "op", "becomes")


def cdc_key_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).select("seqno", "op", F.col("pk").alias("old_pk"), F.when(F.col("seqno") % 7 == 0, F.col("pk") + 1).otherwise(F.col("pk")).alias("new_pk"))
    return changelog.split_key_changes(log, "old_pk", "new_pk").select("seqno", "op", "key", "part")


def cdc_explode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    row = lambda i: F.array((n + i).cast("string"), (F.col("user_id") + i).cast("string"))
    short = F.array((n + 2).cast("string"))
    x = table(spark, sf_dir, "events").select((n * 10).alias("seqno"), F.concat(F.lit("e"), n.cast("string")).alias("event_id"), F.array(row(0), row(1), F.when(n % 5 == 0, short).otherwise(row(2))).alias("after"), F.array(row(1), row(0), row(0)).alias("before"))
    out = changelog.explode_rows(x, "after", "before", ["id", "owner"])
    return out.select("seqno", "event_id", F.coalesce(F.element_at("after", "id"), F.lit("raw")).alias("id"), F.coalesce(F.element_at("before", "owner"), F.lit("raw")).alias("old_owner"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    whole = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("prio"), F.col("o_orderpriority"))
    part = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("status"), F.lit("X"))).otherwise(F.create_map(F.lit("extra"), F.lit("E")))
    return o.select("o_orderkey", whole.alias("whole"), part.alias("part"))


def _images_out(x: DataFrame) -> DataFrame:
    of = lambda k: F.coalesce(F.element_at("m", k), F.lit("-")).alias(k)
    return x.select("o_orderkey", of("status"), of("prio"), of("extra"), F.size("m").alias("n"))


def cdc_complete_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images_out(_images(spark, sf_dir).withColumn("m", changelog.overlay(F.col("whole"), F.col("part"))))


def cdc_complete_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images_out(_images(spark, sf_dir).withColumn("m", changelog.overlay(F.col("part"), F.col("whole"))))


def cdc_message_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", changelog.message_key("shop", "lineitem", [F.col("l_orderkey"), F.col("l_linenumber")], F.lit("")).alias("message_key"))
    return x


def cdc_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = change_log(spark, sf_dir)
    of = lambda s: changelog.topic(s, "sync", "t1", F.lit("app"), F.col("event_type"))
    return x.select("seqno", of("TABLE").alias("by_table"), of("TASK").alias("by_task"), of("GLOBAL").alias("for_all"))


def cdc_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from the messages: their text differs by engine."""
    x = change_log(spark, sf_dir)
    image = F.struct(F.col("pk").alias("id"), F.col("event_type").alias("kind"))
    source = F.struct(F.lit("app").alias("db"), F.col("event_type").alias("table"), F.col("seqno"), F.col("tx_id").alias("txId"))
    body = changelog.envelope(image, image, source, F.col("op"), epoch_ms(F.col("source_ts")), F.struct(F.col("tx_id").cast("string").alias("id")))
    x = x.select("seqno", body.alias("m"))
    of = lambda path, name: F.coalesce(F.get_json_object("m", f"$.payload.{path}"), F.lit("-")).alias(name)
    return x.select("seqno", of("before.id", "before_id"), of("after.kind", "after_kind"), of("source.txId", "tx"), of("op", "op"), of("ts_ms", "ts_ms"))


def cdc_envelope_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = change_log(spark, sf_dir)
    body = changelog.simple_envelope(F.col("op"), F.lit("app"), F.col("event_type"), F.struct(F.col("pk").alias("id")), epoch_ms(F.col("source_ts")))
    x = x.select("seqno", body.alias("m"))
    return x.select("seqno", F.get_json_object("m", "$.op").alias("op"), F.get_json_object("m", "$.data.id").alias("id"), F.get_json_object("m", "$.table").alias("tbl"))


def doc_cdc_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by key: whole ones are put, excluded ones and deletes remove, events without a document do nothing."""
    x = change_log(spark, sf_dir).withColumn("doc", F.when(F.col("seqno") % 11 != 0, F.concat(F.lit("d"), F.col("seqno").cast("string"))))
    x = x.where("op = 'd' OR doc IS NOT NULL").withColumn("op", F.when((F.col("op") != "d") & (F.col("seqno") % 5 == 0), F.lit("d")).otherwise(F.col("op")))
    return changelog.apply_latest(x, ["pk"]).select("pk", "doc")


def tx_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).select("seqno", F.when(F.col("tx_id") % 10 != 0, F.col("tx_id")).alias("tx_id"))
    return changelog.tx_order(log).select("seqno", "tx_order")


def tx_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.tx_markers(change_log(spark, sf_dir)).withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def tx_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.tx_runs(change_log(spark, sf_dir), "node")


def tx_complete_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).withColumn("tx_last", (F.col("seqno") % 4 == 3) & (F.col("tx_id") % 9 != 0))
    return changelog.tx_complete(log, "tx_last").select("seqno", "tx_id")


def bidi_loop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).withColumn("marker", (F.col("tx_id") % 6 == 0) & (F.col("seqno") % 4 == 1))
    return changelog.without_loops(log, "marker").select("seqno", "tx_id")


def low_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).withColumn("failed", (F.col("seqno") > 200) & (F.col("pk") % 10 == 7))
    out = changelog.low_watermark(log, "node", "failed")
    return out.withColumn("watermark", F.coalesce("watermark", F.lit(-1)))


def _contended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with source days that tie and go back."""
    day = F.datediff(F.to_date("source_ts"), F.lit("2020-01-01").cast("date")) - F.col("seqno") % 3
    return change_log(spark, sf_dir).select("seqno", "pk", "node", day.cast("bigint").alias("source_ts"))


def conflict_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.last_write_wins(_contended(spark, sf_dir), ["pk"]).select("pk", "seqno", "node", "source_ts")


def conflict_node_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.decide(_contended(spark, sf_dir), ["pk"], "node_priority", "n1").select("pk", "seqno", "node", "source_ts", "decision")


def conflict_lww_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.decide(_contended(spark, sf_dir), ["pk"], "lww").select("pk", "seqno", "decision")


def conflict_before_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _contended(spark, sf_dir).withColumn("seen", F.col("pk") * 10 + F.col("seqno") % 2)
    held = log.groupBy("pk").agg(F.max("source_ts").alias("held_ts"), F.min("node").alias("held_node")).withColumn("held", F.col("pk") * 10)
    return conflicts.before_image_check(log, held, ["pk"], "seen", "held").select("seqno", "decision")


def conflict_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).select("seqno", (F.floor(F.col("seqno") / 50)).cast("bigint").alias("batch"), F.concat(F.lit("app."), F.col("event_type")).alias("tbl"), F.when(F.col("pk") % 40 != 0, F.col("pk")).alias("row_key"))
    return conflicts.conflict_keys(log, "batch", "tbl", "row_key").select("seqno", "conflict_key")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events share a transaction, in batches of 40 transactions."""
    log = change_log(spark, sf_dir).withColumn("batch", F.floor(F.col("tx_id") / 40))
    node = lambda c: (F.col("batch") * 1_000_000 + F.col(c)).cast("bigint")
    one = log.groupBy("batch", "tx_id").agg(F.min("pk").alias("least"))
    return log.join(one, ["batch", "tx_id"]).select(node("pk").alias("a"), node("least").alias("b"))


def conflict_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.conflict_components(_edges(spark, sf_dir), "a", "b")


def dependency_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).select("seqno", F.floor(F.col("seqno") / 100).cast("bigint").alias("batch"), (F.col("seqno") % 37 == 0).alias("barrier"), F.when(F.col("pk") % 9 != 0, F.col("pk") % 12).alias("key"))
    return conflicts.dependency_layers(log, "batch", "key", "barrier").select("seqno", F.col("layer").cast("bigint").alias("layer"))


def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(epoch_ms(F.col("ts")) / 1000).cast("bigint").alias("at"))
    return folds.cooldown(x, ["user_id"], "at", ["event_id"], 86_400).select("event_id", "fired")


def backpressure_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.pmod(F.col("event_id") * F.col("event_id"), F.lit(1009)).cast("double")
    x = table(spark, sf_dir, "events").select("event_id", "user_id", depth.alias("depth"))
    return folds.hysteresis(x, ["user_id"], "event_id", "depth", 300.0, 700.0).select("event_id", "state")


def status_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import metrics

    x = table(spark, sf_dir, "events").select("event_id", "user_id", F.pmod(F.col("event_id") * 7, F.lit(11)).alias("phase"), (F.col("event_type") == "error").alias("control"))
    return metrics.monotone(x, ["user_id"], "event_id", "phase", "control").select("event_id", "accepted")


QUERIES = {
    f.__name__: f
    for f in (
        cdc_apply_latest, cdc_apply_update_ignore, cdc_apply_ignore, upsert_merge, cdc_filter_transition, cdc_key_change, cdc_explode_rows, cdc_complete_after, cdc_complete_before,
        cdc_message_key, cdc_topic, cdc_envelope, cdc_envelope_simple, doc_cdc_apply, tx_order, tx_markers, tx_runs, tx_complete_only, bidi_loop_guard, low_watermark,
        conflict_lww, conflict_node_priority, conflict_lww_decisions, conflict_before_image, conflict_keys, conflict_components, dependency_layers, alert_cooldown, backpressure_state, status_monotone,
    )
}

_DAY = "date_diff('day', DATE '2020-01-01', source_ts::DATE) - seqno % 3"
_CONTENDED = f"{LOG}, c AS (SELECT seqno, pk, node, ({_DAY})::BIGINT AS source_ts, row_number() OVER (PARTITION BY pk ORDER BY seqno) AS i FROM log)"


def _decided(wins: str) -> str:
    """Steps along each key, as a recursive query."""
    ok = f"(c.source_ts > s.ts OR (c.node = s.held AND c.source_ts = s.ts) OR (c.node <> s.held AND c.source_ts <= s.ts AND {wins}))"
    return f"""WITH RECURSIVE {_CONTENDED}, s AS (SELECT pk, i, seqno, node, source_ts, source_ts AS ts, node AS held, 'APPLY' AS decision FROM c WHERE i = 1
      UNION ALL SELECT c.pk, c.i, c.seqno, c.node, c.source_ts, CASE WHEN {ok} THEN c.source_ts ELSE s.ts END, CASE WHEN {ok} THEN c.node ELSE s.held END, CASE WHEN {ok} THEN 'APPLY' ELSE 'SKIP' END
      FROM s JOIN c ON c.pk = s.pk AND c.i = s.i + 1)"""


_IMAGES = "SELECT o_orderkey, o_orderkey % 2 = 0 AS even, o_orderstatus, o_orderpriority FROM orders"

PRIMARY = "c.node = 'n1'"

SQL = {
    "cdc_apply_latest": f"WITH {LOG} SELECT pk, seqno, op, value FROM log QUALIFY row_number() OVER (PARTITION BY pk ORDER BY seqno DESC) = 1 AND op <> 'd'",
    "cdc_apply_update_ignore": f"""WITH {LOG}, g AS (SELECT pk, coalesce(max(seqno) FILTER (WHERE op = 'd'), -1) AS gone FROM log GROUP BY pk), a AS (SELECT log.* FROM log JOIN g USING (pk) WHERE op <> 'd' AND seqno > gone)
        SELECT pk, max(seqno) AS seqno, arg_max(op, seqno) AS op FROM a GROUP BY pk HAVING count(*) FILTER (WHERE op = 'c') > 0""",
    "cdc_apply_ignore": f"""WITH {LOG}, g AS (SELECT pk, coalesce(max(seqno) FILTER (WHERE op = 'd'), -1) AS gone FROM log GROUP BY pk)
        SELECT pk, min(seqno) AS seqno, arg_min(value, seqno) AS value FROM log JOIN g USING (pk) WHERE op = 'c' AND seqno > gone GROUP BY pk""",
    "upsert_merge": """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name || '!' ELSE c_name END AS c_name, c_nationkey FROM customer
        UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey FROM customer WHERE c_custkey % 25 = 0""",
    "cdc_filter_transition": f"""WITH {LOG}, x AS (SELECT seqno, op, CASE WHEN op = 'u' THEN CASE WHEN pk % 4 <> 0 AND seqno % 3 = 0 THEN 'd' WHEN pk % 4 = 0 AND seqno % 3 <> 0 THEN 'c' WHEN pk % 4 <> 0 THEN 'u' END
        WHEN op = 'd' AND pk % 4 <> 0 THEN 'd' WHEN op = 'c' AND seqno % 3 <> 0 THEN 'c' END AS becomes FROM log) SELECT * FROM x WHERE becomes IS NOT NULL""",
    "cdc_key_change": f"""WITH {LOG} SELECT seqno, 'd' AS op, pk AS key, 0 AS part FROM log WHERE op = 'u' AND seqno % 7 = 0 UNION ALL SELECT seqno, 'c', pk + 1, 1 FROM log WHERE op = 'u' AND seqno % 7 = 0
        UNION ALL SELECT seqno, op, CASE WHEN op = 'c' AND seqno % 7 = 0 THEN pk + 1 ELSE pk END, 0 FROM log WHERE NOT (op = 'u' AND seqno % 7 = 0)""",
    "cdc_explode_rows": """SELECT event_id * 10 + r.i AS seqno, 'e' || event_id || '_' || r.i AS event_id, CASE WHEN r.i = 2 AND event_id % 5 = 0 THEN 'raw' ELSE (event_id + r.i)::VARCHAR END AS id,
        CASE r.i WHEN 0 THEN (user_id + 1)::VARCHAR ELSE user_id::VARCHAR END AS old_owner FROM events, range(3) AS r(i)""",
    "cdc_complete_after": f"SELECT o_orderkey, CASE WHEN even THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority AS prio, CASE WHEN even THEN '-' ELSE 'E' END AS extra, CASE WHEN even THEN 2 ELSE 3 END AS n FROM ({_IMAGES})",
    "cdc_complete_before": f"SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS prio, CASE WHEN even THEN '-' ELSE 'E' END AS extra, CASE WHEN even THEN 2 ELSE 3 END AS n FROM ({_IMAGES})",
    "cdc_message_key": "SELECT l_orderkey, l_linenumber, 'shop.lineitem.' || l_orderkey || '_' || l_linenumber AS message_key FROM lineitem",
    "cdc_topic": "SELECT event_id AS seqno, 'sync.t1.app.' || event_type AS by_table, 'sync.t1' AS by_task, 'sync.events' AS for_all FROM events",
    "cdc_envelope": f"WITH {LOG} SELECT seqno, CASE WHEN op = 'c' THEN '-' ELSE pk::VARCHAR END AS before_id, CASE WHEN op = 'd' THEN '-' ELSE event_type END AS after_kind, tx_id::VARCHAR AS tx, op, (epoch_us(source_ts) // 1000)::VARCHAR AS ts_ms FROM log",
    "cdc_envelope_simple": f"WITH {LOG} SELECT seqno, op, pk::VARCHAR AS id, event_type AS tbl FROM log",
    "doc_cdc_apply": f"""WITH {LOG}, x AS (SELECT pk, seqno, CASE WHEN op <> 'd' AND seqno % 5 = 0 THEN 'd' ELSE op END AS op, CASE WHEN seqno % 11 <> 0 THEN 'd' || seqno END AS doc FROM log WHERE op = 'd' OR seqno % 11 <> 0)
        SELECT pk, doc FROM x QUALIFY row_number() OVER (PARTITION BY pk ORDER BY seqno DESC) = 1 AND op <> 'd'""",
    "tx_order": f"WITH {LOG} SELECT seqno, CASE WHEN tx_id % 10 = 0 THEN 0 ELSE row_number() OVER (PARTITION BY tx_id ORDER BY seqno) END::INT AS tx_order FROM log",
    "tx_markers": f"WITH {LOG}, t AS (SELECT tx_id, min(seqno) AS a, max(seqno) AS b, count(*) AS n FROM log GROUP BY tx_id) SELECT tx_id, 'BEGIN' AS marker, a AS seqno, 0::BIGINT AS event_count FROM t UNION ALL SELECT tx_id, 'END', b, n FROM t",
    "tx_runs": f"""WITH {LOG}, x AS (SELECT *, CASE WHEN lag(tx_id) OVER (PARTITION BY node ORDER BY seqno) IS NOT DISTINCT FROM tx_id AND lag(seqno) OVER (PARTITION BY node ORDER BY seqno) IS NOT NULL THEN 0 ELSE 1 END AS starts FROM log),
        r AS (SELECT *, (sum(starts) OVER (PARTITION BY node ORDER BY seqno))::BIGINT AS run FROM x) SELECT node, run, min(tx_id) AS tx_id, min(seqno) AS first_seqno, max(seqno) AS last_seqno, count(*) AS events FROM r GROUP BY node, run""",
    "tx_complete_only": f"WITH {LOG} SELECT seqno, tx_id FROM log WHERE tx_id IN (SELECT tx_id FROM log WHERE seqno % 4 = 3 AND tx_id % 9 <> 0)",
    "bidi_loop_guard": f"WITH {LOG}, m AS (SELECT tx_id, min(seqno) AS marked FROM log WHERE tx_id % 6 = 0 AND seqno % 4 = 1 GROUP BY tx_id) SELECT seqno, tx_id FROM log LEFT JOIN m USING (tx_id) WHERE marked IS NULL OR seqno < marked",
    "low_watermark": f"""WITH {LOG}, f AS (SELECT node, min(seqno) AS failed FROM log WHERE seqno > 200 AND pk % 10 = 7 GROUP BY node)
        SELECT node, coalesce(max(seqno) FILTER (WHERE failed IS NULL OR seqno < failed), -1) AS watermark FROM log LEFT JOIN f USING (node) GROUP BY node""",
    "conflict_lww": f"WITH {_CONTENDED} SELECT pk, seqno, node, source_ts FROM c QUALIFY row_number() OVER (PARTITION BY pk ORDER BY source_ts DESC, node DESC, seqno DESC) = 1",
    "conflict_node_priority": f"{_decided(PRIMARY)} SELECT pk, seqno, node, source_ts, decision FROM s",
    "conflict_lww_decisions": f"{_decided('c.source_ts = s.ts AND c.node > s.held')} SELECT pk, seqno, decision FROM s",
    "conflict_before_image": f"""WITH {_CONTENDED}, h AS (SELECT pk, max(source_ts) AS held_ts, min(node) AS held_node FROM c GROUP BY pk)
        SELECT seqno, CASE WHEN seqno % 2 = 0 OR source_ts > held_ts OR (source_ts = held_ts AND node >= held_node) THEN 'APPLY' ELSE 'SKIP' END AS decision FROM c JOIN h USING (pk)""",
    "conflict_keys": f"""WITH {LOG}, x AS (SELECT seqno, seqno // 50 AS batch, 'app.' || event_type AS tbl, pk FROM log), w AS (SELECT DISTINCT batch, tbl FROM x WHERE pk % 40 = 0)
        SELECT seqno, CASE WHEN w.tbl IS NOT NULL THEN 'T|' || x.tbl ELSE 'R|' || x.tbl || '|' || pk END AS conflict_key FROM x LEFT JOIN w ON x.batch = w.batch AND x.tbl = w.tbl""",
    "conflict_components": f"""WITH RECURSIVE {LOG}, x AS (SELECT tx_id // 40 AS batch, tx_id, pk FROM log), l AS (SELECT batch, tx_id, min(pk) AS least_ FROM x GROUP BY ALL),
        e AS (SELECT DISTINCT batch * 1000000 + pk AS a, batch * 1000000 + least_ AS b FROM x JOIN l USING (batch, tx_id)), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT a AS node, a AS other FROM w UNION SELECT r.node, w.b FROM r JOIN w ON r.other = w.a) SELECT node, min(other) AS root FROM r GROUP BY node""",
    "dependency_layers": f"""WITH {LOG}, x AS (SELECT seqno, seqno // 100 AS batch, seqno % 37 = 0 AS barrier, CASE WHEN pk % 9 <> 0 THEN pk % 12 END AS key FROM log),
        s AS (SELECT *, coalesce(sum(barrier::INT) OVER (PARTITION BY batch ORDER BY seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM x),
        d AS (SELECT *, CASE WHEN barrier OR key IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY batch, seg, barrier, key ORDER BY seqno) END AS depth FROM s),
        g AS (SELECT batch, seg, coalesce(max(depth) FILTER (WHERE NOT barrier), 0) AS deep FROM d GROUP BY batch, seg),
        b AS (SELECT *, coalesce(sum(deep + 1) OVER (PARTITION BY batch ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM g)
        SELECT seqno, (CASE WHEN barrier THEN base + deep ELSE base + depth - 1 END)::BIGINT AS layer FROM d JOIN b USING (batch, seg)""",
    "alert_cooldown": """WITH RECURSIVE x AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS i FROM events),
        s AS (SELECT event_id, user_id, i, t AS last_, true AS fired FROM x WHERE i = 1 UNION ALL
          SELECT x.event_id, x.user_id, x.i, CASE WHEN x.t - s.last_ >= 86400 THEN x.t ELSE s.last_ END, x.t - s.last_ >= 86400 FROM s JOIN x ON x.user_id = s.user_id AND x.i = s.i + 1) SELECT event_id, fired FROM s""",
    "backpressure_state": """WITH x AS (SELECT event_id, user_id, (event_id * event_id) % 1009 AS depth FROM events),
        m AS (SELECT *, CASE WHEN depth > 700 THEN 'PAUSED' WHEN depth < 300 THEN 'RUNNING' END AS said FROM x)
        SELECT event_id, coalesce(last_value(said IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'RUNNING') AS state FROM m""",
    "status_monotone": """WITH x AS (SELECT event_id, user_id, (event_id * 7) % 11 AS phase, event_type = 'error' AS control FROM events),
        m AS (SELECT *, max(CASE WHEN NOT control THEN phase END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM x) SELECT event_id, control OR far IS NULL OR phase >= far AS accepted FROM m""",
}
