"""Folds, streams, sinks and sources against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changelog, compare, conflicts, folds, routing
from tidemark.sources import readers, selection, sinks
from tidemark.streaming import apply, timed


def random_log(n=400, seed=3):
    r = random.Random(seed)
    return [(i, r.randrange(12), r.choice("cuud"), r.choice(["n1", "n2", "n3"]), r.randrange(20), f"v{i}") for i in range(n)]


SCHEMA = "seqno bigint, pk bigint, op string, node string, source_ts bigint, v string"


@pytest.mark.parametrize("missing", ["upsert", "ignore"])
def test_apply_is_the_sequential_fold(spark, missing):
    log, state = random_log(), {}
    for s, pk, op, _, _, v in log:
        if op == "d":
            state.pop(pk, None)
        elif op == "c" or missing == "upsert" or pk in state:
            state[pk] = (s, v)
    got = changelog.apply_latest(spark.createDataFrame(log, SCHEMA), ["pk"], missing)
    assert {r.pk: (r.seqno, r.v) for r in got.collect()} == state


def test_last_write_wins_is_the_sequential_rule(spark):
    log, held = random_log(), {}
    for s, pk, _, node, ts, _ in log:
        now = held.get(pk)
        if now is None or ts > now[0] or (ts == now[0] and node >= now[1]):
            held[pk] = (ts, node, s)
    got = conflicts.last_write_wins(spark.createDataFrame(log, SCHEMA), ["pk"])
    assert {r.pk: (r.source_ts, r.node, r.seqno) for r in got.collect()} == held
    empty = conflicts.last_write_wins(spark.createDataFrame([(1, None, "c", "n1", 5, "v")], SCHEMA), ["pk"])
    assert empty.count() == 1


def sequential(log, policy, primary=None):
    """Decisions by the rules, one event at a time: {seqno: decision}."""
    held, out = {}, {}
    for s, pk, _, node, ts, _ in sorted(log):
        if pk is None or ts is None:
            out[s] = "APPLY"
            continue
        now = held.get(pk)
        if now is None or ts > now[0]:
            said = "APPLY"
        elif node == now[1]:
            said = "APPLY" if ts == now[0] else "SKIP"
        elif policy == "error":
            said = "ERROR"
        else:
            wins = node == primary if policy == "node_priority" else ts == now[0] and node > now[1]
            said = "APPLY" if wins else "SKIP"
        if said == "APPLY":
            held[pk] = (ts, node)
        out[s] = said
    return out


@pytest.mark.parametrize("policy", ["lww", "node_priority", "error"])
def test_decisions_are_the_sequential_rules(spark, policy):
    big, r = 2**60, random.Random(7)
    log = [(s, r.choice([None, big, big + 1, 3]), op, node, r.choice([None, big + ts, big + ts + 1]), v) for s, _, op, node, ts, v in random_log(300)]
    got = conflicts.decide(spark.createDataFrame(log, SCHEMA).repartition(3), ["pk"], policy, "n1").collect()
    assert {r.seqno: r.decision for r in got} == sequential(log, policy, "n1")
    assert {(r.seqno, r.pk, r.source_ts) for r in got} == {(x[0], x[1], x[4]) for x in log}
    if policy != "node_priority":
        lost = {r.seqno: r.winner for r in conflicts.conflict_log(spark.createDataFrame(log, SCHEMA), ["pk"], policy).collect()}
        said = sequential(log, policy)
        assert all(said[s] == ("APPLY" if w == "INCOMING" else "SKIP" if policy == "lww" else "ERROR") for s, w in lost.items()) and "STORED" in lost.values()


def test_folds_with_nulls(spark):
    rows = [(None, 1, 5), (None, 2, 6), (None, 3, None), (None, 4, 400), (1, 1, None), (1, 2, 2**60), (1, 3, 2**60 + 1), (1, 4, 2**60 + 300)]
    df = spark.createDataFrame(rows, "k bigint, seqno bigint, at bigint")
    fired = {(r.k, r.seqno) for r in folds.cooldown(df, ["k"], "at", ["seqno"], 300).collect() if r.fired}
    assert fired == {(None, 1), (None, 4), (1, 2), (1, 4)}
    levels = spark.createDataFrame([(None, i, x) for i, x in enumerate([1.0, 9.0, None, 5.0, 2.0, 5.0])], "k bigint, seqno bigint, level double")
    assert [r.state for r in folds.hysteresis(levels, ["k"], "seqno", "level", 3.0, 8.0).orderBy("seqno").collect()] == ["RUNNING", "PAUSED", "PAUSED", "PAUSED", "RUNNING", "RUNNING"]


def test_cooldown_by_scan(spark):
    """Many keys and one hot key, null keys and times, ties, over several batches."""
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(0, 40_000, 7)]), i) for i in range(25_000)]
    last, want = {}, set()
    for k, at, i in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        if at is not None and (last.get(k) is None or at - last[k] >= 60):
            last[k] = at
            want.add(i)
    got = folds.cooldown(spark.createDataFrame(rows, "k string, at bigint, i bigint"), ["k"], "at", ["i"], 60)
    assert {x.i for x in got.where("fired").collect()} == want and got.count() == len(rows)
    assert folds.cooldown(spark.createDataFrame([], "k string, at bigint, i bigint"), ["k"], "at", ["i"]).count() == 0


@pytest.mark.parametrize("width", [3, 100_000])
def test_hysteresis_by_scan(spark, width):
    r = random.Random(width)
    rows = [(r.choice(["a", None]), i, r.choice([None, 10.0, 50.0, 90.0])) for i in range(300)]
    state, want = {}, {}
    for k, i, v in rows:
        if v is not None and (v > 80 or v < 20):
            state[k] = "PAUSED" if v > 80 else "RUNNING"
        want[i] = state.get(k, "RUNNING")
    got = folds.hysteresis(spark.createDataFrame(rows, "k string, i bigint, v double"), ["k"], "i", "v", 20.0, 80.0, width)
    assert got.columns == ["k", "i", "v", "state"] and {x.i: x.state for x in got.collect()} == want


def test_parts_of_a_keyed_table():
    assert [sinks.KeyedTable.parts_for(n) for n in (0, 1, 1 << 30, (1 << 30) + 1, 100 << 40)] == [1, 1, 1, 2, 1 << 17]


def test_circuit_breaker(spark):
    calls = [(0, True), (1, True), (2, False), (3, True), (4, True), (5, True), (6, False), (110, True), (200, False), (320, False), (330, True)]
    df = spark.createDataFrame([("t", i, at, bad) for i, (at, bad) in enumerate(calls)], "k string, seqno bigint, at bigint, bad boolean")
    got = [r.state for r in folds.breaker(df, ["k"], "seqno", "at", "bad", most=3, open_ms=100).orderBy("seqno").collect()]
    assert got == ["CLOSED"] * 6 + ["OPEN", "HALF_OPEN", "OPEN", "HALF_OPEN", "CLOSED"]


@pytest.mark.parametrize("width", [1, 7, 50, 1_000_000])
def test_runs_do_not_depend_on_ranges(spark, width):
    r, rows, runs = random.Random(5), [], {}
    for s in range(300):
        rows.append((s * 3, r.choice("ab"), r.choice([None, 1, 1, 2])))
    for s, node, tx in rows:
        mine = runs.setdefault(node, [])
        if mine and mine[-1][1] == tx:
            mine[-1][3:] = [s, mine[-1][4] + 1]
        else:
            mine.append([len(mine) + 1, tx, s, s, 1])
    got = changelog.tx_runs(spark.createDataFrame(rows, "seqno bigint, node string, tx_id bigint"), "node", width)
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(str((n, *x)) for n, mine in runs.items() for x in mine)


def test_components_by_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(900, 900)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = conflicts.conflict_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert {(x.node, x.root) for x in got} == {(i, find(i)) for i in root} and len(got) == len(root)


def test_filter_transition(spark):
    rows = [(False, True), (True, False), (True, True), (False, False)]
    df = spark.createDataFrame([("u", *r) for r in rows], "op string, b boolean, a boolean")
    assert [r[0] for r in df.select(changelog.filter_transition(F.col("op"), F.col("b"), F.col("a"))).collect()] == ["d", "c", None, "u"]


def test_repair(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    t = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "id int, v string")
    diff = compare.row_diff(s, t, ["id"])
    assert {(r.id, r.diff_type, r.fields) for r in diff.collect()} == {(1, "SOURCE_ONLY", ""), (2, "CONTENT_DIFF", "v"), (4, "TARGET_ONLY", "")}
    assert compare.row_diff(s, compare.repaired(s, t, diff, ["id"]), ["id"]).isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    log = random_log()
    source, sink = str(tmp_path / "log"), sinks.KeyedTable(spark, str(tmp_path / "table"), ["pk"], 4)
    for part in range(4):
        spark.createDataFrame(log[part * 100 : part * 100 + 100], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    apply.apply_stream(stream, sink, str(tmp_path / "c")).awaitTermination()
    want = {(r.pk, r.seqno) for r in changelog.apply_latest(spark.createDataFrame(log, SCHEMA), ["pk"]).collect()}
    assert {(r.pk, r.seqno) for r in apply.live_rows(sink).collect()} == want
    apply.apply_batch(sink, spark.createDataFrame(log[:50], SCHEMA))  # a replay changes nothing
    assert {(r.pk, r.seqno) for r in apply.live_rows(sink).collect()} == want


def test_decisions_of_a_stream(spark, tmp_path):
    log = random_log()
    spark.createDataFrame(log, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log"))
    q = apply.decide_stream(stream, "pk").writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = conflicts.decide(spark.createDataFrame(log, SCHEMA), ["pk"], "lww")
    assert {tuple(r) for r in spark.sql("SELECT seqno, decision FROM decided").collect()} == {(r.seqno, r.decision) for r in batch.collect()}


def test_windows_of_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seqno"), F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = apply.throughput_stream(apply.first_of_each(stream.withWatermark("ts", "10 minutes"), ["seqno"]), "ts", "1 hour").writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0.9 * events.count() < spark.sql("SELECT sum(events) FROM rates").first()[0] <= events.count()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "cap").write_text("a\u0001b\nbroken\n")
    got = readers.read_captured(spark, str(tmp_path / "cap"), ["x", "y"]).collect()
    assert [(r.x, r.y, r.raw) for r in got] == [("a", "b", None), (None, None, "broken")]
    (tmp_path / "lat").write_text("2\t1\t1\tINSERT\n")
    assert readers.read_latencies(spark, str(tmp_path / "lat")).first().latency_ms == 1
    df = spark.createDataFrame([(1, "12"), (2, "x")], "id int, n string")
    good, bad = sinks.split_rejects(df, {"number": lambda d: d["n"].try_cast("int").isNotNull()})
    assert good.count() == 1 and bad.first().reasons == ["number"]
    routed = routing.split_route(df, routing.SplitRule("id", "hash_mod", count=2))
    sinks.write_shards(routed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2
    lines = sinks.index_requests(df.withColumn("op", F.when(F.col("id") == 1, "d").otherwise("c")), "Db", "T", ["id"]).collect()
    assert lines[0].value == '{"delete":{"_index":"db_t","_id":"1"}}' and '"n":"x"' in lines[1].value
    outcome = sinks.fan_out(df, {"good": lambda b: b.count(), "bad": lambda b: 1 / 0})
    assert outcome == {"good": "ok", "bad": "failed: ZeroDivisionError"}


def test_keyed_table(spark, tmp_path):
    t = sinks.KeyedTable(spark, str(tmp_path / "t"), ["pk"], 4)
    assert t.read() is None
    t.expire(10)
    rows = lambda n, v: spark.createDataFrame([(i, i, "c", v) for i in n], "pk bigint, seqno bigint, op string, v string")
    t.merge(rows(range(100), "a"))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    t.merge(rows([3], "b"))
    t.merge(rows([], "x"))
    kept = [p for p, at in before.items() if p.exists() and p.stat().st_mtime_ns == at]
    assert 0 < len(kept) < len(before) and len({p.parent for p in kept}) == 3  # one partition was rewritten
    assert {(r.pk, r.v) for r in t.read().collect()} == {(i, "b" if i == 3 else "a") for i in range(100)}
    t.merge(spark.createDataFrame([(i, 200 + i, "d", None) for i in range(100)], "pk bigint, seqno bigint, op string, v string"))
    t.expire(250)
    left = sorted(r.pk for r in t.read().collect())
    assert set(range(50, 100)) <= set(left) and len(left) <= 54


def test_jdbc_writes_what_is_missing(spark):
    url, driver = "jdbc:derby:memory:tidemark_write;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.range(50).selectExpr("id AS ID", "CAST(id * 2 AS INT) AS V")
    df.where("ID < 20").write.format("jdbc").options(url=url, dbtable="W", driver=driver).save()
    assert sinks.write_jdbc(df.unionByName(df.where("ID = 30")), url, "W", ["ID"], batch=7, driver=driver) == {"rows": 51, "written": 30, "skipped": 21}
    assert sinks.write_jdbc(df, url, "W", ["ID"], driver=driver) == {"rows": 50, "written": 0, "skipped": 50}
    assert readers.read_jdbc(spark, url, "W", "ID", 3, driver=driver).agg(F.sum("V")).first()[0] == 2 * sum(range(50))


def test_loads_and_statistics(spark, tmp_path):
    told = sinks.load_tables({"a": lambda: 1, "b": lambda: 1 / 0, "c": lambda: 2}, 2)
    assert told == {"a": "ok", "b": "failed: ZeroDivisionError", "c": "ok"}
    assert sinks.load_tables({"b": lambda: 1 / 0, "c": lambda: 2}, 1, stop=True)["c"] == "not begun"
    df, seen = sinks.load_statistics(spark.createDataFrame([(1, "ab"), (2, None)], "id bigint, v string"), ["id", "v"])
    df.write.parquet(str(tmp_path / "x"))
    assert seen.get == {"rows": 2, "bytes": 8 + 6 + 8 + 1}


def test_error_policies(spark):
    log = spark.createDataFrame([(i, f"e{i}", i == 5) for i in range(10)], "seqno bigint, event_id string, failed boolean")
    good, aside = sinks.route_errors(log, "failed", ["e1"], [2], "DEAD_LETTER")
    assert {r.seqno for r in good.collect()} == {0, 3, 4, 6, 7, 8, 9} and {(r.seqno, r.reason) for r in aside.collect()} == {(1, "skipped"), (2, "skipped"), (5, "failed")}
    good, aside = sinks.route_errors(log, "failed", ["e5"], [])
    assert good.count() == 9 and aside.first().seqno == 5
    with pytest.raises(Exception, match="event failed at 5"):
        sinks.route_errors(log, "failed", [], [])[0].collect()


def test_transactions_of_a_stream(spark, tmp_path):
    rows = [(1, 1, False), (2, 2, False), (3, 1, True), (4, 3, False), (5, 2, True)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "seqno bigint, tx_id bigint, tx_last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("seqno bigint, tx_id bigint, tx_last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = timed.whole_transactions(stream, 1000).writeStream.format("memory").queryName("whole").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            got = {(r.seqno, r.tx_id, r.flushed) for r in spark.sql("SELECT * FROM whole").collect()}
            if len(got) == 5:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert got == {(1, 1, False), (3, 1, False), (2, 2, False), (5, 2, False), (4, 3, True)}


def test_jdbc_in_ranges(spark):
    url, driver = "jdbc:derby:memory:tidemark;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(-5, 95).withColumnRenamed("id", "ID").write.format("jdbc").options(url=url, dbtable="T", driver=driver).save()
    df = readers.read_jdbc(spark, url, "T", "ID", 4, driver=driver)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100
    assert df.where("ID > 90").count() == 4


def test_selection():
    got = selection.parse_selection('{"mysql": [], "a": ["t"], "b": {"tables": ["x"], "tableMapping": {"x": "y"}, "targetDb": "c"}, "d": []}')
    assert [(s.database, s.table, s.target_database, s.target_table) for s in got] == [("a", "t", "a", "t"), ("b", "x", "c", "y"), ("d", "*", "d", "*")]
