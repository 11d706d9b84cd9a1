"""Comparison by trees of digests: no false match, whatever the key, and only unequal ranges read again."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import compare, digest_tree


def verdict(s, t, pk):
    return tuple(compare.content_compare("t", s, t, pk, 8, 3).first())[1:]


@pytest.mark.parametrize(
    ("schema", "one", "other"),
    [
        ("id int, a string, b string", [(1, "x|y", "z")], [(1, "x", "y|z")]),
        ("id int, a string", [(1, None)], [(1, "\\N")]),
        ("id int, a string, b string", [(1, "1:x", None)], [(1, None, "1:x")]),
        ("id int, v double", [(1, 0.00001)], [(1, 0.00002)]),
        ("id int, v double", [(1, 1e40)], [(1, 2e40)]),
        ("id int, v float", [(1, 1.0000001)], [(1, 1.0)]),
        ("id int, v array<string>", [(1, ["a, b"])], [(1, ["a", "b"])]),
        ("id int, v struct<a:int,b:int>", [(1, (1, None))], [(1, (None, 1))]),
        ("id int, v map<string,string>", [(1, {"a": None})], [(1, {})]),
        ("id int, v binary", [(1, b"\x00\x01")], [(1, b"\x00")]),
    ],
)
def test_no_false_match(spark, schema, one, other):
    s, t = spark.createDataFrame(one, schema), spark.createDataFrame(other, schema)
    assert verdict(s, t, ["id"]) == (0, 0, 1, "MISMATCH")
    assert verdict(s, t, None)[-1] == "NO_PK"
    assert verdict(s, s.repartition(3), ["id"]) == (0, 0, 0, "MATCH") == verdict(s, s, None)


def test_rows_that_repeat_without_a_key(spark):
    two = lambda *v: spark.createDataFrame([(x,) for x in v], "a string")
    assert verdict(two("A", "A"), two("B", "B"), None)[-1] == "NO_PK"
    assert verdict(two("A", "A", "B"), two("A", "B", "B"), None)[-1] == "NO_PK"
    assert verdict(two("A", "B", "A"), two("B", "A", "A"), None)[-1] == "MATCH"


def test_values_that_are_equal_in_other_types(spark):
    s = spark.createDataFrame([(1, Decimal("1.50"), -0.0), (2, Decimal("10.00"), 1.0)], "id int, d decimal(10,2), f double")
    t = spark.createDataFrame([(1, Decimal("1.5000"), 0.0), (2, Decimal("10.0000"), 1.0)], "id bigint, d decimal(20,4), f double")
    assert verdict(s, t, ["id"]) == (0, 0, 0, "MATCH")


def keyed(kind, i):
    day = dt.date(2020, 1, 1) + dt.timedelta(days=i)
    of = {"bigint": 10**18 + i * 3 * (i // 60 * 10**6 + 1), "decimal(38,0)": Decimal(i) * 10**30, "string": f"k{i % 7}|{i}", "date": day, "timestamp": dt.datetime(2020, 1, 1) + dt.timedelta(microseconds=i * 7), "timestamp_ntz": dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), "double": i / 3, "binary": str(i).encode()}
    return of[kind]


@pytest.mark.parametrize("kind", ["bigint", "decimal(38,0)", "string", "date", "timestamp_ntz", "bigint+string"])
def test_verdicts_by_brute_force(spark, kind):
    r, kinds = random.Random(kind), kind.split("+")
    pk = [f"k{i}" for i in range(len(kinds))]
    rows = {tuple(keyed(k, i // (j + 1)) if j == 0 and len(kinds) > 1 else keyed(k, i) for j, k in enumerate(kinds)): r.choice(["a", "b", None]) for i in range(120)}
    other = {k: v for k, v in rows.items() if r.random() > 0.05}
    other |= {k: r.choice(["a", "b", None]) for k in r.sample(sorted(other), 10)}
    other |= {tuple(keyed(k, 500 + i) for k in kinds): "new" for i in range(4)}
    schema = ", ".join(f"{c} {k}" for c, k in zip(pk, kinds, strict=True)) + ", v string"
    s, t = (spark.createDataFrame([(*k, v) for k, v in x.items()], schema) for x in (rows, other))
    want = (len(rows.keys() - other.keys()), len(other.keys() - rows.keys()), sum(other[k] != v for k, v in rows.items() if k in other))
    assert verdict(s, t, pk) == (*want, "MISMATCH" if any(want) else "MATCH")
    assert verdict(s, s.repartition(2), pk)[-1] == "MATCH"


def test_only_unequal_ranges_are_read_again(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.range(20_000).selectExpr("id * 3 AS id", "id % 11 AS v").repartitionByRange(16, "id").sortWithinPartitions("id").write.parquet(path)
    s = spark.read.parquet(path)
    t = s.where("id <> 9000").withColumn("v", F.when(F.col("id").isin(9003, 42_000), -1).otherwise(F.col("v")))
    found = digest_tree.unequal(s, t, ["id", "v"], ["id"], 32, 2)
    assert [x[0] for x in found.levels] == [0, 1, 2] and found.levels[0][1:] == (1, 39_999) and found.levels[1][1] == 2
    again = (found.source.count(), found.target.count())
    assert sum(again) == found.levels[2][2] and 3 <= again[0] <= 80 and again[1] == again[0] - 1
    plan = found.source._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(id," in plan
    diff = compare.row_diff(found.source, found.target, ["id"]).collect()
    assert {(d.id, d.diff_type) for d in diff} == {(9000, "SOURCE_ONLY"), (9003, "CONTENT_DIFF"), (42_000, "CONTENT_DIFF")}


def test_equal_tables_are_read_once(spark):
    s = spark.range(1000).withColumn("v", F.col("id") % 7)
    found = digest_tree.unequal(s, s.repartition(5), ["id", "v"], ["id"], 16, 2)
    assert found.levels == [(0, 0, 0)] and found.source.isEmpty() and found.target.isEmpty()


def test_empty_tables_and_null_keys(spark):
    s = spark.createDataFrame([(None, "a"), (1, "b")], "id int, v string")
    assert verdict(s.where("false"), s.where("false"), ["id"])[-1] == "MATCH"
    assert verdict(s.where("id = 1"), s.where("false"), ["id"]) == (1, 0, 0, "MISMATCH")
    assert verdict(s, s.repartition(2), ["id"])[-1] == "MATCH"
    assert verdict(s, s.where("id = 1"), ["id"]) == (1, 0, 0, "MISMATCH")


def test_checksum(spark):
    df = spark.range(5000).selectExpr("id * 7 AS id", "id % 5 AS v")
    one = lambda d, **k: tuple(digest_tree.checksum(d, ["id", "v"], ["id"], **k).first())
    assert one(df) == one(df.repartition(9)) and one(df)[0] == 5000
    assert one(df, fan=10, levels=3) != one(df.withColumn("v", F.when(F.col("id") == 700, 9).otherwise(F.col("v"))), fan=10, levels=3)
    assert one(df.where("false"))[0] == 0


def test_few_ranges_cover_all(spark):
    r = random.Random(2)
    for _ in range(50):
        at = sorted(r.sample(range(1000), r.randint(1, 60)))
        ranges = digest_tree._merged([(a, a) for a in at], 7)
        assert len(ranges) <= 7 and all(any(a <= x <= b for a, b in ranges) for x in at)
