"""Logs by the columns of their time, copies handed over to their log, and graphs in layers, each against a sequential version."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import handover, layers, schema_log


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_as_of_by_scan(spark, width):
    r = random.Random(width)
    events = [(r.choice(["a", "b", None]), r.randrange(200), i) for i in range(300)]
    at = {}
    for _ in range(40):
        at[(r.choice(["a", "b", "c", None]), r.randrange(-20, 220))] = r.choice(["x", "y", None])
    versions = [(k, s, v) for (k, s), v in at.items()]
    got = schema_log.as_of(spark.createDataFrame(events, "t string, seqno bigint, i int"), spark.createDataFrame(versions, "t string, seqno bigint, v string"), ["t"], "seqno", "v", width)
    want = [(t, s, i, max(((vs, v) for k, vs, v in versions if k == t and vs <= s), key=lambda x: x[0], default=(0, None))[1]) for t, s, i in events]
    assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(map(str, want))


def random_schema_log(seed, n=250):
    """Statements and rows of three tables, and what each row should be."""
    r, cols, ddl, log, want, made = random.Random(seed), {}, [], [], {}, 0
    for seqno in range(n):
        t = r.choice(["d.a", "d.b", "e.c"])
        now = cols.get(t)
        if r.random() < 0.2:
            made += 1
            kind = r.choice(["create", "add", "add_after", "first", "drop", "rename", "move", "gone", "key", "truncate"])
            if kind == "create" or now is None or len(now) < 2:
                cols[t] = [f"c{made}_{i}" for i in range(r.randint(2, 4))]
                sql = f"CREATE TABLE {t} (" + ", ".join(f"`{c}` DECIMAL(10,2) DEFAULT '(,'" for c in cols[t]) + f", PRIMARY KEY ({cols[t][0]}))"
            elif kind == "gone":
                cols[t], sql = None, f"DROP TABLE {t}"
            elif kind == "key":
                sql = f"ALTER TABLE {t} ADD UNIQUE KEY k ({now[0]})"
            elif kind == "truncate":
                sql = f"TRUNCATE TABLE {t}"
            else:
                a, b = r.sample(now, 2)
                sql, cols[t] = {
                    "add": (f"ALTER TABLE {t} ADD n{made} INT", [*now, f"n{made}"]), "add_after": (f"alter table {t} add column n{made} enum('a','b') after {a.upper()}", now[: now.index(a) + 1] + [f"n{made}"] + now[now.index(a) + 1 :]),
                    "first": (f"ALTER TABLE {t} ADD COLUMN n{made} INT FIRST", [f"n{made}", *now]), "drop": (f"ALTER TABLE {t} DROP COLUMN {a}, ADD KEY k ({b})", [c for c in now if c != a]),
                    "rename": (f"ALTER TABLE {t} CHANGE {a} r{made} INT", [f"r{made}" if c == a else c for c in now]), "move": (f"ALTER TABLE {t} MODIFY `{a}` INT AFTER `{b}`", [x for c in now if c != a for x in ([c, a] if c == b else [c])]),
                }[kind]
            ddl.append((seqno, sql))
        else:
            values = [f"v{seqno}_{i}" for i in range(r.choice([2, 3, 4, len(now or []), len(now or [])]))]
            log.append((t, seqno, values))
            want[seqno] = dict(zip(now, values, strict=True)) if now is not None and len(now) == len(values) else None
    return ddl, log, want


@pytest.mark.parametrize(("seed", "width"), [(1, 1000), (2, 16), (3, 1)])
def test_rows_named_by_their_time(spark, seed, width):
    ddl, log, want = random_schema_log(seed)
    versions = schema_log.schema_versions(spark.createDataFrame(ddl, "seqno bigint, sql string"))
    got = schema_log.named_rows(spark.createDataFrame(log, "table string, seqno bigint, values array<string>"), versions, "values", width).collect()
    assert {r.seqno: r.image for r in got} == want and len(got) == len(log)
    assert all((r.image is None) == (r.reason is not None) for r in got)


def test_a_hot_table_s_statements_are_folded_in_parts(spark):
    """Columns of one table by a plain fold, whatever the ranges; what lies between two CREATEs is a group."""
    sql = {i: f"CREATE TABLE d.a (x{i} INT)" if i % 10 == 0 else f"DROP TABLE d.a, d.b{i}" if i % 25 == 3 else f"ALTER TABLE d.a ADD COLUMN y{i} INT" for i in range(200)}
    now, want = None, {}
    for i, x in sql.items():
        now = [f"x{i}"] if x[0] == "C" else None if x[0] == "D" or now is None else [*now, f"y{i}"]
        want[i] = now
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for width in (7, 100_000):
            got = schema_log.schema_versions(spark.createDataFrame(list(sql.items()), "seqno bigint, sql string"), width=width).where("table = 'd.a'").select("*", F.spark_partition_id().alias("part")).collect()
            assert len(got) == 200 and {r.seqno: r.columns for r in got} == want and len({r.part for r in got}) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tables_renamed_are_unknown(spark):
    ddl = [(1, "CREATE TABLE d.a (x INT)"), (5, "RENAME TABLE d.a TO d.b"), (9, "CREATE TABLE d.a (y INT)"), (12, "ALTER TABLE d.a RENAME TO d.z")]
    log = [("d.a", 2, ["1"]), ("d.a", 6, ["1"]), ("d.b", 7, ["1"]), ("d.a", 10, ["1"]), ("d.a", 13, ["1"]), ("d.q", 2, ["1"])]
    versions = schema_log.schema_versions(spark.createDataFrame(ddl, "seqno bigint, sql string"))
    got = schema_log.named_rows(spark.createDataFrame(log, "table string, seqno bigint, values array<string>"), versions)
    assert {(r.table, r.seqno): r.image for r in got.collect()} == {("d.a", 2): {"x": "1"}, ("d.a", 6): None, ("d.b", 7): None, ("d.a", 10): {"y": "1"}, ("d.a", 13): None, ("d.q", 2): None}


def test_shadow_tables_become_alters(spark):
    ddl = [(1, "CREATE TABLE d.t (id INT, a INT)"), (2, "CREATE TABLE d._t_gho (id INT, a INT, b INT)"), (3, "CREATE TABLE d.t (id INT, a INT, b INT)"), (4, "CREATE TABLE d._t_new (id INT, b INT)"), (5, "CREATE TABLE _x_gho (id INT)"), (6, "ALTER TABLE d._t_gho ADD c INT")]
    got = schema_log.shadow_conversions(spark.createDataFrame(ddl, "seqno bigint, sql string"))
    assert {(r.seqno, r.table, r.sql) for r in got.collect()} == {(2, "d.t", "ALTER TABLE `d`.`t` ADD COLUMN `b` INT"), (4, "d.t", "ALTER TABLE `d`.`t` DROP COLUMN `a`"), (5, ".x", None)}


@pytest.mark.parametrize("seed", range(3))
def test_each_change_counts_once(spark, seed):
    """Copies of key ranges end at different positions of a log of increments, inserts and deletes."""
    r = random.Random(seed)
    log = [(s, r.choice("cud"), r.randrange(60), r.randrange(100)) for s in range(400)]
    cuts = sorted(r.sample(range(55), 6))
    ranges = [(a, b, r.randrange(400)) for a, b in zip(cuts, cuts[1:], strict=False)]

    def state(until):
        rows = {}
        for s, op, k, v in log:
            if s <= until:
                rows.pop(k, None) if op == "d" else rows.__setitem__(k, v)
        return rows

    copied = [(k, v) for low, high, p in ranges for k, v in state(p).items() if low <= k < high]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = df(log, "seqno bigint, op string, k bigint, v int"), df(ranges, "low bigint, high bigint, position bigint"), "k", r.choice([1, 10, 1000])
    got = handover.handed_over(df(copied, "k bigint, v int"), *args)
    assert sorted(tuple(x) for x in got.collect()) == sorted(state(10**9).items())
    # Sums show a change that is lost or counted twice.
    inside = lambda k: next((p for low, high, p in ranges if low <= k < high), -1)
    pending = handover.pending_changes(*args).collect()
    assert sorted(x.seqno for x in pending) == [s for s, _, k, _ in log if s > inside(k)]


def test_a_hot_key_s_changes_meet_in_no_group(spark):
    """Only distinct keys are ordered for their ranges: a window over a key's changes would hold them all."""
    log = spark.range(50_000).select(F.col("id").alias("seqno"), F.lit("u").alias("op"), F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(F.lit(7)).alias("k"), F.col("id").alias("v"))
    ranges = spark.createDataFrame([(0, 10, 40_000), (10, 100_000, 1_000)], "low bigint, high bigint, position bigint")
    pending = handover.pending_changes(log, ranges, "k")
    assert pending.count() == sum(i > (40_000 if i % 100 or not i else 1_000) for i in range(50_000))
    windows = [p for p in pending._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in p]
    assert windows and not any("seqno" in p for p in windows)
    below = pending._jdf.queryExecution().optimizedPlan().toString().split("Window [", 1)[1]
    assert "Aggregate [k" in below


def test_position_lines(spark):
    df = spark.createDataFrame([(5, "CONSISTENT", "mysql", "uuid:1-5|x"), (6, "NONE", "pg", None), (7, "other", "pg", "0/1")], "at bigint, mode string, kind string, p string")
    lines = df.select(handover.position_line(*[F.col(c) for c in df.columns]).alias("line"))
    assert [r.line for r in lines.collect()] == ["5|CONSISTENT|mysql|uuid:1-5|x", None, None]
    back = lines.union(spark.createDataFrame([("x|CONSISTENT|a|b",), ("5|NO|a|b",), ("",)], "line string")).select(handover.parsed_position(F.col("line")).alias("p"))
    assert [r.p and tuple(r.p) for r in back.collect()] == [(5, "CONSISTENT", "mysql", "uuid:1-5|x"), None, None, None, None, None]


def brute_layers(edges):
    nodes, edges = {x for e in edges for x in e}, set(edges)
    reach = {n: set() for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = {b} | reach[b]
            if not new <= reach[a]:
                reach[a] |= new
                changed = True
    on = {n for n in nodes if n in reach[n]}
    layer, out = {}, {}

    def depth(n):
        if n not in layer:
            layer[n] = max((depth(a) + 1 for a, b in edges if b == n), default=0)
        return layer[n]

    for n in nodes:
        if n in on:
            out[n] = (None, "CYCLE", max(m for m in on if m in reach[n] and n in reach[m]))
        elif any(n in reach[c] for c in on):
            out[n] = (None, "BEHIND", None)
        else:
            out[n] = (depth(n), "ORDERED", None)
    return out


@pytest.mark.parametrize(("seed", "n", "m", "up"), [(1, 25, 30, True), (2, 30, 40, False)])
def test_layers_by_brute_force(spark, seed, n, m, up):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    edges = [tuple(sorted(e)) for e in edges if e[0] != e[1]] if up else [*edges, (5, 5)]
    got = layers.graph_layers(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {x.node: (x.layer, x.state, x.cycle) for x in got} == brute_layers(edges) and len(got) == len({x for e in edges for x in e})


def test_long_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(3000)] + [(5000 + i, 5000 + (i + 1) % 50) for i in range(50)] + [(5000, 6000), (6000, 6001), (10, 7000), (7000, 7001)]
    got = {x.node: (x.layer, x.state) for x in layers.graph_layers(spark.createDataFrame(edges, "a bigint, b bigint"), 20).collect()}
    assert all(got[i] == (i, "ORDERED") for i in range(3001)) and all(got[5000 + i] == (None, "CYCLE") for i in range(50))
    assert got[6000] == got[6001] == (None, "BEHIND") and got[7001] == (12, "ORDERED")
    with pytest.raises(ValueError, match="layers"):
        ladder = [(i, i + 1) for i in range(30)] + [(i, i + 2) for i in range(29)]
        layers.graph_layers(spark.createDataFrame(ladder, "a bigint, b bigint"), 10)


def test_creation_order(spark):
    tables = spark.createDataFrame([(n,) for n in ("order", "customer", "item", "a", "b", "c", "note")], "name string")
    refs = [("order", "customer"), ("item", "order"), ("item", "item"), ("a", "b"), ("b", "a"), ("c", "a"), ("note", "elsewhere")]
    got = layers.creation_order(tables, spark.createDataFrame(refs, "child string, parent string"))
    assert {r.name: (r.step, r.state) for r in got.collect()} == {"customer": (0, "ORDERED"), "order": (1, "ORDERED"), "item": (2, "ORDERED"), "a": (None, "CYCLE"), "b": (None, "CYCLE"), "c": (None, "BEHIND"), "note": (0, "ORDERED")}
