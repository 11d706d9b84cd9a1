"""State with timers, framed files, documents by path, and loads that find their bad rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import documents
from tidemark.sources import framed, readers, sinks
from tidemark.streaming import timed


def rows_until(spark, query, table, enough):
    """Rows of a memory sink once ``enough`` says so, or after a minute."""
    for _ in range(60):
        got = spark.sql(f"SELECT * FROM {table}").collect()
        if enough(got):
            return got
        query.awaitTermination(1)
    return got


def test_heartbeats_of_idle_sources(spark, tmp_path):
    schema = "source string, seqno bigint"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    put([("a", 5), ("a", 7), ("b", 1)])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    start = lambda name: timed.heartbeats(stream, 500, 500).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    q = start("beats")
    try:
        got = rows_until(spark, q, "beats", lambda rows: sum(r.kind == "HEARTBEAT" and r.source == "a" for r in rows) >= 2)
        assert {(r.source, r.seqno) for r in got if r.kind == "EVENTS"} == {("a", 7), ("b", 1)}
        beats = sorted((r.beat, r.seqno) for r in got if r.kind == "HEARTBEAT" and r.source == "a")
        assert beats[:2] == [(1, 7), (2, 7)]
        put([("a", 6), ("a", 9)])
        got = rows_until(spark, q, "beats", lambda rows: any(r.kind == "HEARTBEAT" and r.seqno == 9 for r in rows))
        assert [(r.seqno, r.beat) for r in got if r.source == "a" and r.seqno == 9][:2] == [(9, 0), (9, 1)]
    finally:
        q.stop()


def test_transactions_outlive_a_restart(spark, tmp_path):
    schema = "seqno bigint, tx_id bigint, tx_last boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    put([(1, 1, False), (2, 2, True)])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    schema_out = "seqno bigint, tx_id bigint, flushed boolean"

    def run(want, batches):
        q = timed.whole_transactions(stream, 3_600_000).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            for _ in range(60):
                read = sum(p["numInputRows"] for p in q.recentProgress)
                got = {(r.seqno, r.tx_id, r.flushed) for r in spark.read.schema(schema_out).parquet(str(tmp_path / "out")).collect()} if read >= batches else set()
                if got == want:
                    return
                q.awaitTermination(1)
        finally:
            q.stop()
        assert got == want

    run({(2, 2, False)}, 2)
    put([(3, 1, False)])
    run({(2, 2, False)}, 1)
    put([(4, 1, True)])
    run({(2, 2, False), (1, 1, False), (3, 1, False), (4, 1, False)}, 1)


def write_frames(folder, rows):
    at = folder / f"first={rows[0][0]}" / f"last={rows[-1][0]}"
    at.mkdir(parents=True)
    (at / "0.frames").write_bytes(b"".join(framed.frame(*r) for r in rows))
    return at / "0.frames"


def test_framed_files(spark, tmp_path):
    log = [(i, f"event {i}".encode() * (i % 5)) for i in range(1, 61)]
    for i in range(0, 60, 20):
        last = write_frames(tmp_path / "log", log[i : i + 20])
    got = framed.read_frames(spark, str(tmp_path / "log"))
    assert sorted((r.seqno, bytes(r.payload)) for r in got.collect()) == log
    behind = framed.read_frames(spark, str(tmp_path / "log"), 25)
    assert sorted(r.seqno for r in behind.collect()) == list(range(26, 61))
    assert "PartitionFilters: [isnotnull(last" in behind._jdf.queryExecution().executedPlan().toString()
    q = framed.stream_frames(spark, str(tmp_path / "log"), 25, 1).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.seqno for r in spark.sql("SELECT * FROM frames").collect()) == list(range(26, 61))
    last.write_bytes(last.read_bytes()[:-3])
    got = framed.read_frames(spark, str(tmp_path / "log"), 40).collect()
    assert sorted(r.seqno for r in got if r.error is None) == list(range(41, 60)) and [r.error[:7] for r in got if r.error] == ["cut off"]
    last.write_bytes(b"\xff\xff\xff\xff" + b"x" * 20)
    assert [r.error for r in framed.read_frames(spark, str(tmp_path / "log"), 40).collect()] == ["no length at byte 0: -1"]


def test_sealed_frames(spark, tmp_path):
    key = "0123456789abcdef"
    sealed = spark.createDataFrame([(1, "one"), (2, "two")], "seqno bigint, p string").select("seqno", F.aes_encrypt("p", F.lit(key)).alias("p")).collect()
    write_frames(tmp_path / "log", [(r.seqno, bytes(r.p)) for r in sealed])
    opened = readers.read_sealed(framed.read_frames(spark, str(tmp_path / "log")), "payload", key)
    assert sorted((r.seqno, r.payload) for r in opened.collect()) == [(1, "one"), (2, "two")]


def flat(value, path=""):
    if isinstance(value, dict) and value:
        return {k: v for name, inner in value.items() for k, v in flat(inner, f"{path}.{name}" if path else name).items()}
    if isinstance(value, list) and value:
        return {k: v for i, inner in enumerate(value) for k, v in flat(inner, f"{path}[{i}]").items()}
    return {path: value}


def random_document(r, depth=0):
    kind = r.choice(["n", "s", "null", "obj", "arr"] if depth < 4 else ["n", "s"])
    if depth == 0 or kind == "obj":
        return {r.choice("abcd"): random_document(r, depth + 1) for _ in range(r.randint(0 if depth else 1, 3))}
    return {"n": r.choice([1, 2.5, -7]), "s": r.choice(["x", "y,{"]), "null": None, "arr": None}[kind] if kind != "arr" else [random_document(r, depth + 1) for _ in range(r.randint(0, 3))]


def test_documents_by_path(spark):
    r = random.Random(4)
    docs = [(i, random_document(r)) for i in range(60)]
    other = [(i, d if r.random() < 0.5 else random_document(r)) for i, d in docs if i % 7] + [(100, {"a": 1})]
    df = lambda rows: spark.createDataFrame([(i, json.dumps(d)) for i, d in rows], "id int, text string").select("id", documents.document(F.col("text")).alias("doc"))
    got = documents.document_paths(df(docs), "id", "doc").collect()
    want = {(i, p, json.dumps(v, separators=(",", ":"))) for i, d in docs for p, v in flat(d).items()}
    assert {(x.id, x.path, x.value) for x in got} == want and len(got) == len(want)
    diff = {x.id: (x.diff_type, x.paths) for x in documents.path_diff(df(docs), df(other), "id", "doc").collect()}
    left, right = dict(docs), dict(other)
    expect = {}
    for i in left.keys() | right.keys():
        if i in left and i in right:
            a, b = flat(left[i]), flat(right[i])
            missing = object()
            paths = sorted(p for p in a.keys() | b.keys() if a.get(p, missing) != b.get(p, missing))
            if paths:
                expect[i] = ("CONTENT_DIFF", paths)
        else:
            expect[i] = ("SOURCE_ONLY" if i in left else "TARGET_ONLY", [])
    assert diff == expect


def test_documents_are_read_once(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":null}]}}')], "id int, text string").select("id", documents.document(F.col("text")).alias("doc"))
    found = documents.document_paths(docs, "id", "doc")
    assert {(x.path, x.value, x.kind) for x in found.collect()} == {("a.b[0]", "1", "BIGINT"), ("a.b[1].c", "null", "VOID")}
    assert len(found._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("|").split("|")) == 1


def test_documents_are_told_apart_within_their_row(spark):
    """Each side is read once and only documents are shuffled; unequal places count though their paths look alike, and equal ones don't."""
    long = lambda n: json.dumps({"x": list(range(n)), "y:": {"0": [[], {}, None]}})
    df = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", documents.document(F.col("text")).alias("doc"))
    deep = '{"a":' * 20 + "%d" + "}" * 20
    a = df('{"":{"a":1},"a":2}', '{"":{"a":1},"a":2}', long(3000), deep % 1, deep % 1, '{"_id":1,"é:":"1"}', '{"_id":1}', '{"v":"1"}')
    b = df('{"a":2.0,"":{"a":1}}', '{"":{"a":2},"a":1}', long(3001), deep % 2, deep % 1, '{"_id":2,"é:":1}', '{"_id":2}', '{"v":1}')
    found = documents.path_diff(a, b, "id", "doc")
    want = {1: [".a", "a"], 2: ["x[3000]"], 3: [".".join("a" * 16)], 5: ["é:"], 7: ["v"]}
    assert {x.id: (x.diff_type, x.paths) for x in found.collect()} == {i: ("CONTENT_DIFF", paths) for i, paths in want.items()}
    plan = found._jdf.queryExecution().optimizedPlan()
    assert len(plan.collectLeaves().mkString("|").split("|")) == 2 and plan.toString().count("Join ") == 1


def test_documents_that_are_equal_or_none(spark):
    df = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", documents.document(F.col("text")).alias("doc"))
    a, b = df('{"a":1,"b":{"c":[1,2]},"_id":1}', "{broken", '{"x.y":1}', None), df('{"b":{"c":[1.0,2]},"a":1.00,"_id":2}', None, '{"x":{"y":1}}', '{"a":null}')
    got = {x.id: (x.diff_type, x.paths) for x in documents.path_diff(a, b, "id", "doc").collect()}
    assert got == {2: ("CONTENT_DIFF", ["x.y", "x\\.y"]), 3: ("CONTENT_DIFF", ["a"])}
    rule = lambda *r: [x[0] for x in a.orderBy("id").select(documents.path_excluded(F.col("doc"), list(r))).collect()]
    assert rule(("$.a", ">=", "1")) == [True, False, False, False] and rule(("$.b.c[1]", "<", "10")) == [True, False, False, False]
    assert rule(("$.q", "<>", "1"), ("$.a", "<", "1")) == [False] * 4
    with pytest.raises(ValueError, match="comparison"):
        documents.path_excluded(F.col("doc"), [("$.a", "~", "1")])


def test_a_load_finds_its_bad_rows(spark):
    url, driver = "jdbc:derby:memory:bisected;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    gate = spark._jvm.java.sql.DriverManager
    spark._jvm.java.lang.Class.forName(driver)
    con = gate.getConnection(url)
    con.createStatement().execute("CREATE TABLE T (ID BIGINT PRIMARY KEY, V INT CHECK (V < 1000))")
    bad = {17, 18, 250}
    rows = spark.range(300).select(F.col("id").alias("ID"), F.when(F.col("id").isin(*bad), 5000).otherwise(F.col("id")).cast("int").alias("V"))
    write = lambda part: sinks.write_jdbc(part, url, "T", ["ID"], driver=driver)
    rejects = sinks.load_bisected(rows, ["ID"], write)
    assert {r.ID for r in rejects.collect()} == bad and all("CHECK" in r.error.upper() or "constraint" in r.error for r in rejects.collect())
    there = spark.read.format("jdbc").options(url=url, dbtable="T", driver=driver).load()
    assert {r.ID for r in there.collect()} == set(range(300)) - bad
    with pytest.raises(RuntimeError, match="more than 2"):
        sinks.load_bisected(rows.withColumn("ID", F.col("ID") + 1000), ["ID"], write, 2)
    assert sinks.load_bisected(rows.where("V < 1000"), ["ID"], write).isEmpty()
