"""Routing by hand-worked values."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import route_config, routing
from tidemark.operators.routing import SplitRule


def shards(spark, rule, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, k {kind}")
    return [r[0] for r in df.select("i", rule.shard(F.col("k")).alias("s")).orderBy("i").select("s").collect()]


def test_hash(spark):
    rule = SplitRule("k", "hash_mod", count=16)
    assert shards(spark, rule, [33, -3, 21], "bigint") == [1, 13, 5]
    assert shards(spark, rule, ["5", "5.0", "abc"]) == [5, 5, 2]


def test_range(spark):
    rule = SplitRule("k", "range", ranges=((0, 100), (100, 5000), (5000, 10000)))
    assert shards(spark, rule, [0, 99, 100, 9999, 10000, None], "bigint") == [0, 0, 1, 2, None, None]


def test_list(spark):
    rule = SplitRule("k", "list", values=(("CN", 0), ("US", 1)))
    assert shards(spark, rule, ["CN", "US", "us", "DE", None]) == [0, 1, 1, None, None]


def test_date(spark):
    rule = SplitRule("k", "date_format", pattern="yyyyMM")
    df = spark.createDataFrame([("2026-08-03",), ("2026-01-05T10:00:00",), ("2025-12-31 23:59:59",), ("no",)], "k string")
    assert [r.target_table for r in routing.split_route(df, rule).collect()] == ["t_202608", "t_202601", "t_202512", None]


def test_placement_and_broadcast(spark):
    df = spark.createDataFrame([(33,), (None,)], "k bigint")
    rule = SplitRule("k", "hash_mod", count=16, database="dw_${shard/4}", table="order_${shard}", nodes=4)
    out = routing.split_route(df, rule)
    assert out.where("k IS NULL").count() == 16
    r = out.where("k = 33").first()
    assert (r.target_db, r.target_table, r.target_node) == ("dw_0", "order_1", 0)
    other = SplitRule("k", "hash_mod", count=16, nodes=4, node="${shard%4}")
    assert routing.split_route(df, other).where("k = 33").first().target_node == 1


def test_error_and_bad_rules(spark):
    df = spark.createDataFrame([(None,)], "k bigint")
    with pytest.raises(PySparkException):
        routing.split_route(df, SplitRule("k", "hash_mod", count=2, unrouted="error")).collect()
    for bad in ({"kind": "no"}, {"kind": "hash_mod", "count": 0}, {"kind": "hash_mod", "count": 2, "table": "t"}, {"kind": "hash_mod", "count": 2, "unrouted": "x"}):
        with pytest.raises(ValueError):
            SplitRule("k", **bad)


def test_merge_checks_columns(spark):
    a = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError):
        routing.merge_tagged([("n", "d", "t", a.withColumn("x", F.lit(1)))], ["ID"])
    assert routing.merge_tagged([("n", "d", "t", a), ("n", "d", "u", a)], ["ID"]).count() == 2


SPLIT = {"route.mode": "split", "route.split.1.match": "app.order", "route.split.1.shard.key": "k", "route.split.1.count": "4", "route.split.1.target.table": "order_${shard}"}


def test_configured_routes(spark):
    routes = route_config.parse_routes(SPLIT)
    assert routes.of("APP.order").shards == 4 and routes.of("app.other") is None
    assert routes.compare_targets("n", "app.order") == [("app", f"order_{i}", "") for i in range(4)] and routes.compare_targets("n", "a.b") == [("a", "b", "")]
    df = spark.createDataFrame([(5,), (6,)], "k bigint")
    assert sorted((r.target_db, r.target_table) for r in route_config.routed(df, "app.order", routes).collect()) == [("app", "order_1"), ("app", "order_2")]
    assert route_config.routed(df, "a.b", routes).select("target_db", "target_table").distinct().collect() == [("a", "b")]
    merge = route_config.parse_routes({"route.mode": "MERGE", "route.merge.1.match": "regex:db\\d+\\.t", "route.merge.1.target": "dw.all", "route.merge.1.tag.columns": "_src_db"})
    assert merge.compare_targets("n", "db7.t") == [("dw", "all", "_src_db = 'db7'")] and merge.of("dbx.t") is None
    date = SPLIT | {"route.split.1.algo": "DATE_FORMAT", "route.split.1.date.format": "yyyyMM", "route.split.1.unrouted": "ERROR"}
    assert route_config.parse_routes(date).compare_targets("n", "app.order") is None and route_config.parse_routes({}).mode == "NONE"
    ranges = SPLIT | {"route.split.1.algo": "RANGE", "route.split.1.range": "0:10,10:20"}
    assert route_config.parse_routes(ranges).of("app.order").ranges == ((0, 10), (10, 20))


@pytest.mark.parametrize(
    "wrong",
    [
        {"route.mode": "BOTH"}, {"route.split.1.count": "0"}, {"route.split.1.count": "x"}, {"route.split.1.algo": "ROUND"}, {"route.split.1.target.table": "t"}, {"route.split.1.target.table": "t_${shard%2}"},
        {"route.split.1.target.table": "a b${shard}"}, {"route.split.1.unrouted": "LOSE"}, {"route.split.1.target.group": "g"}, {"route.split.1.algo": "RANGE", "route.split.1.range": "0:10,5:20"},
        {"route.split.1.algo": "LIST", "route.split.1.list": "CN"}, {"route.split.1.algo": "DATE_FORMAT"}, {"route.split.1.shard.key": ""}, {"route.split.2.match": "x.y"}, {"route.mode": "MERGE"},
        {"route.mode": "MERGE", "route.merge.1.match": "a.b", "route.merge.1.target": "a-b"}, {"route.mode": "MERGE", "route.merge.1.match": "a.b", "route.merge.1.target": "c", "route.merge.1.pk.strategy": "ANY"},
    ],
)
def test_wrong_routes_are_errors(wrong):
    with pytest.raises(ValueError):
        route_config.parse_routes(SPLIT | wrong)
