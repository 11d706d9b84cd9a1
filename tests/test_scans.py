"""Scans by ranges against the plain window and against loops."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import conflicts, metrics
from tidemark.operators.scans import before

ROWS = [(random.Random(i).choice(["a", "a", "a", "b", None]), i * 3 - 200 if i % 50 else None, random.Random(-i).choice([None, *range(20)])) for i in range(300)]


@pytest.mark.parametrize("width", [1, 7, 100, 100_000])
def test_before(spark, width):
    x = spark.createDataFrame([r for r in ROWS if r[1] is not None], "k string, at bigint, v bigint")
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pair = F.when(F.col("v").isNotNull(), F.struct("v", -F.col("at")))
    want = x.select("k", "at", "v", F.max(pair).over(w).alias("top"), F.sum("v").over(w).alias("all"))
    got = before(x, ["k"], "at", {"top": ("max", pair), "all": ("sum", F.col("v"))}, width)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_without_order_and_no_rows(spark):
    x = spark.createDataFrame([("a", None, 5), ("a", 1, 7), ("a", -10**15, 1)], "k string, at bigint, v bigint")
    got = {r.v: r.far for r in before(x, ["k"], "at", {"far": ("sum", F.col("v"))}, 10).collect()}
    assert got == {5: None, 1: 5, 7: 6}
    assert before(x.limit(0), ["k"], "at", {"far": ("max", F.col("v"))}).collect() == []


def test_rows_are_shuffled_once(spark):
    x = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("at"), F.lit("text").alias("more"))
    plan = before(x, ["k"], "at", {"n": ("sum", F.lit(1).cast("long"))}, 2)._jdf.queryExecution().executedPlan().toString()
    # One of the rows, one of the ranges' totals, one of the totals by key.
    assert "Join" not in plan and plan.count("Exchange") == 3


def layers_of(rows):
    """Layers by a loop over each batch."""
    out, now = {}, {}
    for batch, seqno, key, barrier in sorted(rows, key=lambda r: r[1]):
        base, depth = now.get(batch, (0, {}))
        if barrier:
            at = base + max(depth.values(), default=0)
            now[batch] = (at + 1, {})
        else:
            deep = depth.get(key, 0) + 1 if key is not None else 1
            depth[key], at = max(deep, depth.get(key, 0)), base + deep - 1
            now[batch] = (base, depth)
        out[seqno] = at
    return out


@pytest.mark.parametrize("width", [3, 100_000])
def test_layers_of_one_long_batch(spark, width):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, None]), i, rng.choice([None, "a", "a", "a", "b", "c"]), rng.random() < 0.06) for i in range(400)]
    x = spark.createDataFrame(rows, "batch int, seqno bigint, key string, barrier boolean")
    assert {r.seqno: r.layer for r in conflicts.dependency_layers(x, "batch", "key", "barrier", width).collect()} == layers_of(rows)


@pytest.mark.parametrize("policy", ["lww", "error"])
def test_records_by_ranges(spark, policy):
    rng = random.Random(9)
    rows = [(1 if rng.random() < 0.8 else 2, i, rng.randrange(12), rng.choice(["n1", "n2", "n3"])) for i in range(300)]
    x = spark.createDataFrame(rows, "pk bigint, seqno bigint, source_ts bigint, node string")
    said = lambda width: sorted(map(str, conflicts.with_record(x, ["pk"], policy, width).collect()))
    assert said(4) == said(100_000)
    held, want = {}, {}
    for pk, seqno, ts, node in rows:
        want[seqno] = held.get(pk, (None, None))
        if pk not in held or (policy == "lww" and (ts, node) > held[pk]) or ts > held[pk][0]:
            held[pk] = (ts, node)
    assert {r.seqno: (r.held_ts, r.held_node) for r in conflicts.with_record(x, ["pk"], policy, 4).collect()} == want


def test_quota_and_phases_by_ranges(spark):
    rows = [(i % 2, i, i * 40, (i * 7) % 11, i % 5 == 0) for i in range(100)]
    x = spark.createDataFrame(rows, "k int, i bigint, at bigint, phase int, exempt boolean")
    taken, want = {}, {}
    for k, i, at, *_ in rows:
        taken[k, at // 500] = taken.get((k, at // 500), 0) + 1
        want[i] = taken[k, at // 500] <= 2
    assert {r.i: r.within for r in metrics.window_quota(x, ["k"], "at", "i", 500, 2, 5).collect()} == want
    far, want = {}, {}
    for k, i, _, phase, exempt in rows:
        want[i] = exempt or phase >= far.get(k, -1)
        far[k] = far.get(k, -1) if exempt else max(phase, far.get(k, -1))
    assert {r.i: r.accepted for r in metrics.monotone(x, ["k"], "i", "phase", "exempt", 5).collect()} == want


@pytest.mark.parametrize(("width", "primary"), [(1, "n1"), (6, "n1"), (6, "n3"), (6, None), (100_000, "n1")])
def test_priority_by_ranges(spark, width, primary):
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 2, 3]), i, rng.randrange(9) + i // 40, rng.choice(["n1", "n2", "n2", "n3", None])) for i in range(400)]
    held, want = {}, {}
    for pk, seqno, ts, node in rows:
        now = held.get(pk)
        wins = now is None or ts > now[0] or (ts == now[0] if node == now[1] else node is not None and node == primary)
        want[seqno] = "APPLY" if wins else "SKIP"
        if wins:
            held[pk] = (ts, node)
    x = spark.createDataFrame([(*r, "more") for r in rows], "pk bigint, seqno bigint, source_ts bigint, node string, more string")
    got = conflicts.decide(x, ["pk"], "node_priority", primary, width)
    assert got.columns == [*x.columns, "decision"] and {r.seqno: r.decision for r in got.collect()} == want


def test_priority_with_times(spark):
    x = spark.createDataFrame([(1, i, f"2020-01-0{1 + d}", n) for i, (d, n) in enumerate([(3, "b"), (1, "a"), (2, "b"), (2, "b"), (2, "c"), (0, "a"), (0, "a")])], "pk bigint, seqno bigint, at string, node string")
    x = x.select("pk", "seqno", F.to_timestamp("at").alias("source_ts"), "node")
    assert [r.decision for r in conflicts.decide(x, ["pk"], "node_priority", "a", 2).orderBy("seqno").collect()] == ["APPLY", "APPLY", "APPLY", "APPLY", "SKIP", "APPLY", "APPLY"]
