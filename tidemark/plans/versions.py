"""Logs by the columns of their time, copies handed over to their log, graphs in layers, and lists within text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists
from ..operators import documents, handover, layers, schema_log
from .inputs import LOG, change_log, dealt, table


def _said(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def schema_versioned_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of four values by the columns their table had then; every fortieth event is a statement that changes these."""
    n, t = F.col("event_id"), F.col("event_type")
    created = F.concat(_said("CREATE TABLE app.", t, " (a INT, `b", n, "` DECIMAL(10,2) DEFAULT '(,', c INT"), F.when(n % 160 == 7, F.lit(", d INT")).otherwise(F.lit("")), F.lit(", PRIMARY KEY (a))"))
    x = table(spark, sf_dir, "events")
    ddl = dealt(spark, sf_dir, "events", "event_id", "event_type").where("event_id % 40 = 7").select(n.alias("seqno"), F.when(n % 80 == 7, created).otherwise(_said("ALTER TABLE app.", t, " ADD COLUMN x", n, " INT, ADD KEY (c)")).alias("sql"))
    log = x.where("event_id % 40 <> 7").select(_said("app.", t).alias("table"), n.alias("seqno"), F.array(*[_said(n, f"_{i}") for i in range(4)]).alias("values"))
    got = schema_log.named_rows(log, schema_log.schema_versions(ddl), "values", 1000)
    said = F.array_join(F.transform(F.map_entries("image"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return got.select("seqno", "table", F.coalesce(said, F.lit("")).alias("image"), F.coalesce("reason", F.lit("")).alias("reason"))


def _copy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A copy of the log's keys in ranges of ten, each as of its own position, every fifth not copied; with the log and the ranges."""
    log = change_log(spark, sf_dir).select("seqno", "op", "pk", "event_type")
    high = log.agg(F.max("seqno")).first()[0] or 0
    ranges = log.select(F.floor(F.col("pk") / 10).cast("bigint").alias("r")).distinct().where("r % 5 <> 4")
    ranges = ranges.select((F.col("r") * 10).alias("low"), (F.col("r") * 10 + 10).alias("high"), F.floor(F.col("r") % 8 * high / 8).cast("bigint").alias("position"))
    seen = log.join(ranges, (F.floor(F.col("pk") / 10) * 10).cast("bigint") == F.col("low")).where("seqno <= position")
    copied = seen.groupBy("pk").agg(F.max_by(F.struct("op", "event_type"), "seqno").alias("l")).where("l.op <> 'd'").select("pk", "l.event_type")
    return copied, log, ranges


def snapshot_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handover.handed_over(*_copy(spark, sf_dir), "pk")


def snapshot_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that each range of the copy still lacks."""
    _, log, ranges = _copy(spark, sf_dir)
    return handover.pending_changes(log, ranges, "pk").groupBy(F.floor(F.col("pk") / 10).cast("bigint").alias("range")).agg(F.count("*").alias("pending"), F.min("seqno").alias("first_seqno"))


def graph_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that lead to others further on, and pairs of users that lead to each other."""
    x = table(spark, sf_dir, "events").select("event_id", "user_id")
    step = (x.agg(F.max("user_id")).first()[0] or 0) // 8 + 1
    edges = x.select(F.col("user_id").alias("a"), (F.col("user_id") + step + F.col("event_id") % 10).alias("b"))
    far = x.where("user_id % 50 = 0").select((F.col("user_id") + 10_000_000).alias("n")).distinct()
    pairs = far.select(F.inline(F.array(*[F.struct((F.col("n") + a).alias("a"), (F.col("n") + b).alias("b")) for a, b in ((0, 1), (1, 0), (1, 2))])))
    return layers.graph_layers(edges.union(pairs)).select("node", F.coalesce("layer", F.lit(-1)).alias("layer"), "state", F.coalesce("cycle", F.lit(-1)).alias("cycle"))


def table_creation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tables: one that has orders refers to the one of a third of its number."""
    tables = table(spark, sf_dir, "customer").select(_said("t", F.col("c_custkey")).alias("name"))
    refs = table(spark, sf_dir, "orders").select("o_custkey").distinct().select(_said("t", F.col("o_custkey")).alias("child"), _said("t", F.floor(F.col("o_custkey") / 3)).alias("parent"))
    return layers.creation_order(tables, refs)


def redo_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = F.col("event_id"), F.col("event_type")
    insert = _said('insert into "APP"."T"("ID","KIND","AT") values (\'', n, "','it''s, ", t, "',TO_DATE('2020-01-01', 'YYYY-MM-DD'));")
    update = _said("""update "APP"."T" set "KIND" = 'C:\\', "N" = NULL where "ID" = '""", n, """' and "KIND" = 'this and """, t, "' and ROWID = 'AAA';")
    delete = _said('delete from "APP"."T" where "ID" = \'', n, "' and \"AT\" IS NULL;")
    text = F.when(n % 4 == 0, insert).when(n % 4 == 1, update).when(n % 4 == 2, delete).otherwise(_said('insert into "APP"."T"("ID","KIND") values (\'', n, "');"))
    r = lists.redo_change(text)
    of = lambda m, k: F.coalesce(F.element_at(m, k), F.lit("-"))
    x = dealt(spark, sf_dir, "events", "event_id", "event_type").select("event_id", r.alias("r"))
    both = [of(F.col(f"r.{m}"), k).alias(f"{k.lower()}_{m}") for m in ("before", "after") for k in ("ID", "KIND", "AT")]
    return x.select("event_id", F.coalesce("r.op", F.lit("?")).alias("op"), *both, F.col("r.raw").isNotNull().alias("unread"))


def array_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.when(n % 7 == 0, _said("{", n, ",}")).when(n % 7 == 1, F.lit("{}")).otherwise(_said("{", n, ',NULL,"a,}', n, '",{1,"}"}}'))
    found = lists.array_values(text)
    return dealt(spark, sf_dir, "events", "event_id").select("event_id", F.coalesce(F.size(found), F.lit(-1)).alias("n"), F.coalesce(F.array_join(found, "|", "null"), F.lit("-")).alias("elements"))


def shadow_alters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadow tables of every part's table: with a wider column and a new one, or without a change."""
    key, size = F.col("p_partkey"), F.col("p_size")
    body = lambda more: _said("` (`id` BIGINT NOT NULL, `name` VARCHAR(", size + more, ") DEFAULT 'a,b', ")
    old, same = F.concat(_said("CREATE TABLE `shop`.`t", key), body(F.lit(0)), F.lit("`n` INT, PRIMARY KEY (`id`))")), F.concat(_said("CREATE TABLE `shop`.`_t", key, "_gho"), body(F.lit(0)), F.lit("`n` INT, PRIMARY KEY (`id`))"))
    new = F.concat(_said("CREATE TABLE `shop`.`_t", key, "_gho"), body(F.lit(1)), F.lit("`kind` ENUM('p,q','r'), `n` INT, PRIMARY KEY (`id`))"))
    x = dealt(spark, sf_dir, "part", "p_partkey", "p_size")
    ddl = x.select((key * 2).alias("seqno"), old.alias("sql")).union(x.select(key * 2 + 1, F.when(key % 3 == 0, same).otherwise(new)))
    return schema_log.shadow_conversions(ddl).select("seqno", "table", F.coalesce("sql", F.lit("")).alias("sql"))


def _documents(spark: SparkSession, sf_dir: str, moved: bool) -> DataFrame:
    """Nested documents of the events; the moved ones lack some, and have other lists, fields and kinds of numbers."""
    n, t = F.col("event_id"), F.col("event_type")
    last = F.when((n % 13 == 0) & F.lit(moved), n + 2).otherwise(n + 1)
    extra = F.when((n % 11 == 0) & F.lit(moved), F.lit(',"new":null')).otherwise(F.lit(""))
    text = F.concat(_said('{"user":{"id":', F.col("user_id"), F.lit(".0" if moved else ""), ',"kind":{"name":"', t, '"}},"list":[', n, ",", last, "]"), extra, F.lit("}"))
    x = dealt(spark, sf_dir, "events", "event_id", "user_id", "event_type").select("event_id", documents.document(text).alias("doc"))
    return x.where("event_id % 17 <> 0") if moved else x


def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of nested documents, without those that a rule over a path excludes."""
    x = _documents(spark, sf_dir, False).where(~documents.path_excluded(F.col("doc"), [("$.user.kind.name", "=", "error"), ("$.list[1]", "<=", "100")]))
    return documents.document_paths(x, "event_id", "doc").select("event_id", "path", "value")


def document_path_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.path_diff(_documents(spark, sf_dir, False), _documents(spark, sf_dir, True), "event_id", "doc")
    return found.select("event_id", "diff_type", F.array_join("paths", ",").alias("paths"))


QUERIES = {f.__name__: f for f in (schema_versioned_log, snapshot_handover, snapshot_pending, graph_layers, table_creation_order, redo_images, array_literals, shadow_alters, document_paths, document_path_diff)}

_RANGES = "r AS (SELECT DISTINCT pk // 10 AS r, ((pk // 10) % 8 * (SELECT max(seqno) FROM log)) // 8 AS position FROM log WHERE (pk // 10) % 5 <> 4)"
SQL = {
    "schema_versioned_log": """WITH v AS (SELECT event_id, event_type, event_id % 40 = 7 AS ddl, max(CASE WHEN event_id % 80 = 7 THEN event_id END) OVER (PARTITION BY event_type ORDER BY event_id) AS made FROM events),
        w AS (SELECT *, string_agg(CASE WHEN ddl AND event_id % 80 <> 7 THEN 'x' || event_id END, ',') OVER (PARTITION BY event_type, made ORDER BY event_id) AS more FROM v),
        c AS (SELECT *, string_split('a,b' || made || ',c' || CASE WHEN made % 160 = 7 THEN ',d' ELSE '' END || coalesce(',' || more, ''), ',') AS names FROM w)
        SELECT event_id AS seqno, 'app.' || event_type AS "table", CASE WHEN len(names) = 4 THEN array_to_string(list_transform(range(1, 5), lambda i: names[i] || '=' || event_id || '_' || (i - 1)), ',') ELSE '' END AS image,
        CASE WHEN made IS NULL THEN 'no columns known' WHEN len(names) <> 4 THEN '4 values for ' || len(names) || ' columns' ELSE '' END AS reason FROM c WHERE NOT ddl""",
    "snapshot_handover": f"WITH {LOG} SELECT pk, arg_max(event_type, seqno) AS event_type FROM log GROUP BY pk HAVING arg_max(op, seqno) <> 'd'",
    "snapshot_pending": f"WITH {LOG}, {_RANGES} SELECT pk // 10 AS range, count(*) AS pending, min(seqno) AS first_seqno FROM log LEFT JOIN r ON r.r = pk // 10 WHERE position IS NULL OR seqno > position GROUP BY 1",
    "graph_layers": """WITH RECURSIVE s AS (SELECT max(user_id) // 8 + 1 AS step FROM events), e AS (SELECT DISTINCT user_id AS a, user_id + step + event_id % 10 AS b FROM events, s),
        p AS (SELECT a AS node, 0 AS d FROM e WHERE a NOT IN (SELECT b FROM e) UNION SELECT e.b, d + 1 FROM p JOIN e ON p.node = e.a),
        far AS (SELECT DISTINCT user_id + 10000000 AS n FROM events WHERE user_id % 50 = 0)
        SELECT node, max(d)::BIGINT AS layer, 'ORDERED' AS state, -1::BIGINT AS cycle FROM p GROUP BY node
        UNION ALL SELECT n + i, -1, CASE WHEN i = 2 THEN 'BEHIND' ELSE 'CYCLE' END, CASE WHEN i = 2 THEN -1 ELSE n + 1 END FROM far, range(3) AS x(i)""",
    "table_creation_order": """WITH RECURSIVE h AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer),
        p AS (SELECT k, k AS now, 0 AS d FROM c UNION ALL SELECT p.k, now // 3, d + 1 FROM p WHERE now > 0 AND now IN (SELECT k FROM h) AND now // 3 IN (SELECT k FROM c))
        SELECT 't' || k AS name, max(d)::BIGINT AS step, 'ORDERED' AS state FROM p GROUP BY k""",
    "redo_images": r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'u' WHEN 2 THEN 'd' ELSE '?' END AS op,
        CASE WHEN event_id % 4 IN (1, 2) THEN event_id::VARCHAR ELSE '-' END AS id_before, CASE event_id % 4 WHEN 1 THEN 'this and ' || event_type ELSE '-' END AS kind_before, '-' AS at_before,
        CASE WHEN event_id % 4 < 2 THEN event_id::VARCHAR ELSE '-' END AS id_after, CASE event_id % 4 WHEN 0 THEN 'it''s, ' || event_type WHEN 1 THEN 'C:\' ELSE '-' END AS kind_after,
        CASE event_id % 4 WHEN 0 THEN '2020-01-01' ELSE '-' END AS at_after, event_id % 4 = 3 AS unread FROM events""",
    "array_literals": """SELECT event_id, CASE event_id % 7 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 4 END::INT AS n,
        CASE event_id % 7 WHEN 0 THEN '-' WHEN 1 THEN '' ELSE event_id || '|null|a,}' || event_id || '|{1,"}"}' END AS elements FROM events""",
    "shadow_alters": """SELECT p_partkey * 2 + 1 AS seqno, 'shop.t' || p_partkey AS "table", CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'ALTER TABLE `shop`.`t' || p_partkey || '` MODIFY COLUMN `name` VARCHAR(' || (p_size + 1) ||
        ') DEFAULT ''a,b'', ADD COLUMN `kind` ENUM(''p,q'', ''r'') AFTER `name`' END AS sql FROM part""",
    "document_paths": """SELECT event_id, path, CASE path WHEN 'user.id' THEN user_id::VARCHAR WHEN 'user.kind.name' THEN '"' || event_type || '"' WHEN 'list[0]' THEN event_id::VARCHAR ELSE (event_id + 1)::VARCHAR END AS value
        FROM events, (SELECT unnest(['user.id', 'user.kind.name', 'list[0]', 'list[1]']) AS path) WHERE event_type <> 'error' AND event_id + 1 > 100""",
    "document_path_diff": """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'SOURCE_ONLY' ELSE 'CONTENT_DIFF' END AS diff_type,
        CASE WHEN event_id % 17 = 0 THEN '' ELSE concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'list[1]' END, CASE WHEN event_id % 11 = 0 THEN 'new' END) END AS paths
        FROM events WHERE event_id % 17 = 0 OR event_id % 13 = 0 OR event_id % 11 = 0""",
}
