"""Column rules, values, masks, types and statements by hand-worked values."""

import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns, ddl, masking, types, values
from tidemark.sources import messages


def one(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in cells.items())) if cells else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_rules_keep_null_and_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, -5.0), (3, 100.01), (4, 99.99)], "id int, amount double")
    assert [r.id for r in columns.keep_rows(df, "amount|<|0;AMOUNT|>|100;nothing|=|1").orderBy("id").collect()] == [1, 4]
    plan = columns.keep_rows(df, "amount|>|100")._jdf.queryExecution().toString()
    assert "amount" in plan
    with pytest.raises(ValueError):
        columns.Exclusion.parse("amount|~|1")


def test_rules_reach_the_scan(spark, sf_dir):
    df = columns.keep_rows(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice|>|1000")
    assert "PushedFilters: [" in (plan := df._jdf.queryExecution().toString()) and "o_totalprice" in plan.split("PushedFilters")[1]


def test_values(spark):
    assert one(spark, values.enum_label(F.lit(2), ["a", "b"])) == "b"
    assert one(spark, values.enum_label(F.lit(9), ["a", "b"])) is None
    assert one(spark, values.set_labels(F.lit(5), ["a", "b", "c"])) == "a,c"
    assert one(spark, values.unsigned(F.lit(-1).cast("bigint"), "bigint").cast("string")) == str(2**64 - 1)
    assert one(spark, values.unsigned(F.lit(-1), "smallint")) == 65535
    assert bytes(one(spark, values.bit_bytes(F.lit(258), 12))) == b"\x01\x02"
    assert one(spark, values.signed_time(F.lit(-3_020_399_000))) == "-838:59:59"
    assert one(spark, values.hex_bytes(F.lit("[B@1"))) is None
    assert one(spark, values.array_text(F.array(F.lit("a"), F.lit(None)))) == "[a, null]"


def test_masks(spark):
    of = lambda mask, text: one(spark, mask(F.lit(text)))
    assert of(masking.phone, "13812345678") == "138****5678"
    assert of(masking.phone, "12345") == "*****"
    assert of(masking.id_card, "11010119900101123X") == "110101********123X"
    assert of(masking.email, "bob@x.org") == "b***@x.org"
    assert of(masking.email, "@x.org") == "******"
    assert of(masking.bank_card, "6222021234567890") == "6222********7890"
    assert of(masking.full, "long enough text") == "********"
    assert of(masking.partial, "abcd") == "a**d"
    assert of(masking.detected, "plain") == "plain"
    assert of(masking.detected, "13812345678") == "138****5678"


def test_types():
    assert types.map_type("mysql", "pg", "bigint unsigned") == "NUMERIC(20,0)"
    assert types.map_type("mysql", "pg", "tinyint(1)") == "BOOLEAN"
    assert types.map_type("mysql", "pg", "bit(8)") == "BYTEA"
    assert types.map_type("pg", "mysql", "timestamptz") == "DATETIME"
    assert types.map_type("pg", "mysql", "int[]") == "TEXT"
    assert types.map_type("pg", "mysql", "numeric(10,2)") == "DECIMAL(10,2)"
    assert types.map_type("pg", "mysql", None) == "TEXT"
    assert types.map_type("oracle", "pg", "NUMBER(9)") == "INTEGER"
    assert types.map_type("oracle", "pg", "NUMBER(19,0)") == "NUMERIC(19)"
    assert types.map_type("oracle", "pg", "timestamp with time zone") == "TIMESTAMPTZ"
    assert types.spark_type("mysql", "int unsigned") == "bigint"
    assert types.spark_type("pg", "int4[]") == "array<int>"


def test_scope(spark):
    rows = spark.createDataFrame([("db1.click",), ("DB2.x",), (None,)], "n string")
    assert [r.n for r in rows.where(columns.in_scope(F.col("n"), ["db*.*"], ["db2.*"])).collect()] == ["db1.click", None]


def test_schema_statements(spark):
    pg = lambda s: one(spark, ddl.translated(F.lit(s), "mysql", "pg"))
    my = lambda s: one(spark, ddl.translated(F.lit(s), "pg", "mysql"))
    assert pg("CREATE TABLE t (a int(11) NOT NULL AUTO_INCREMENT, b bigint unsigned, c double, d enum('int','b') COMMENT 'x int', e json) ENGINE=InnoDB COMMENT='t' AUTO_INCREMENT=7") == "CREATE TABLE t (a SERIAL NOT NULL, b NUMERIC(20,0), c DOUBLE PRECISION, d VARCHAR(255), e JSONB)"
    assert pg("alter table `a` modify column `b` varchar(9)") == 'alter table "a" ALTER COLUMN "b" TYPE varchar(9)' and pg("ALTER TABLE a CHANGE COLUMN b b INT") == "ALTER TABLE a ALTER COLUMN b TYPE INTEGER"
    assert pg("ALTER TABLE a CHANGE COLUMN b c INT") is None and pg("GRANT ALL ON x TO y") is None and pg(None) is None
    assert pg("CREATE INDEX i ON t (c(20)) USING BTREE") == "CREATE INDEX i ON t (c)" and pg("DROP INDEX i ON t") == "DROP INDEX i" and pg("RENAME TABLE a TO b") == "ALTER TABLE a RENAME TO b"
    assert pg("ALTER TABLE t ADD COLUMN time DATETIME DEFAULT 'it''s int'") == "ALTER TABLE t ADD COLUMN time TIMESTAMP DEFAULT 'it''s int'"
    assert my('CREATE TABLE "t" ("a" character varying(9), "b" numeric(5,2), "c" timestamp with time zone, "d" double precision, "e" int4[])') == "CREATE TABLE `t` (`a` VARCHAR(9), `b` DECIMAL(5,2), `c` DATETIME, `d` DOUBLE, `e` TEXT) ENGINE=InnoDB"
    name = lambda s, m: one(spark, ddl.renamed(F.lit(s), m))
    assert name("update `a`.`t` set t = 'from t'", {"a.t": "b.u", "t": "x"}) == "update b.u set t = 'from t'" and name("select t from t join tt on t.a = 1", {"t": "u"}) == "select t from u join tt on u.a = 1"
    merged = one(spark, ddl.merged_table(F.lit("CREATE TABLE t (\n  a INT,\n  PRIMARY KEY (a(10), b)\n) ENGINE=x PARTITION BY HASH(a)"), ["s"]))
    assert merged == "CREATE TABLE t (\n  a INT,\n  PRIMARY KEY (a(10), b, `s`), `s` VARCHAR(64) NOT NULL DEFAULT ''\n) ENGINE=x PARTITION BY HASH(a)"
    assert one(spark, ddl.merged_table(F.lit("CREATE TABLE t (a INT)"), ["s"])) is None
    assert one(spark, ddl.split_table(F.lit("create table if not exists a.t (id int auto_increment) auto_increment=5"), F.lit("t_3"))) == "create table if not exists t_3 (id int)"


def test_create_table(spark):
    text = types.create_table("made", [("id", "bigint unsigned"), ("order", "varchar(9)"), ("at", "datetime"), ("part", "int")], "mysql", {"src": "string"}, ["part"])
    spark.sql(text)
    try:
        assert [(f.name, f.dataType.simpleString()) for f in spark.table("made").schema] == [("id", "decimal(20,0)"), ("order", "string"), ("at", "timestamp_ntz"), ("src", "string"), ("part", "int")]
    finally:
        spark.sql("DROP TABLE made")
    assert types.map_type("pg", "mysql", "timestamp(3)") == "DATETIME" and types.map_type("pg", "mysql", "jsonb_ext") == "JSON"


def test_chain_of_filters(spark):
    steps = [(20, "small", lambda d: d.where("id < 6")), (10, "even", lambda d: d.where("id % 2 = 0")), (15, "broken", lambda d: d.where("nothing = 1"))]
    out, told = columns.chained(spark.range(10), steps)
    assert [r.id for r in out.orderBy("id").collect()] == [0, 2, 4] and {k: o.get["passed"] for k, o in told.items()} == {"even": 5, "small": 3}


def test_messages(spark):
    rows = [(1, '{"type":"UPDATE","database":"d","table":"t","es":9,"data":[{"a":"1","b":"2"}],"old":[{"b":null}]}'), (2, "x"), (3, '{"type":"TIDB_WATERMARK","_tidb":{"watermarkTs":2621440}}'), (4, None)]
    parsed = messages.parse_canal(spark.createDataFrame(rows, "n int, value string"))
    assert {r.n: r.kind for r in parsed.collect()} == {1: "ROW", 2: "BROKEN", 3: "HEARTBEAT", 4: "BROKEN"}
    assert parsed.where("n = 3").select(messages.canal_time().alias("t")).first().t == 10
    r = messages.canal_changes(parsed, ["d"]).first()
    assert (r.op, r.source_ts, r.after, r.before) == ("u", 9, {"a": "1", "b": "2"}, {"a": "1", "b": None}) and messages.canal_changes(parsed, ["e"]).isEmpty()


def test_keys_of_any_width(spark):
    from decimal import Decimal

    from tidemark.operators import changelog, routing

    wide = [1 << 64, (1 << 63) + 5, -(1 << 63) - 1, 12345678901234567890, 10**37 + 3, 5, -3, 10**19 * 7 + 9]
    signed = lambda n: (n + (1 << 63)) % (1 << 64) - (1 << 63)
    text = spark.createDataFrame([(str(n),) for n in wide], "k string").select(routing.shard_hash(F.col("k")).alias("h"))
    assert [r.h for r in text.collect()] == [signed(n) for n in wide]
    number = spark.createDataFrame([(Decimal(n),) for n in wide], "k decimal(38,0)").select(routing.shard_hash(F.col("k")).alias("h"))
    assert [r.h for r in number.collect()] == [signed(n) for n in wide]
    assert [r.h for r in spark.createDataFrame([("5.00",), ("abc",), (None,), ("5.5",)], "k string").select(routing.shard_hash(F.col("k")).alias("h")).collect()] == [5, zlib.crc32(b"abc"), None, zlib.crc32(b"5.5")]
    keys = spark.createDataFrame([(1, None, 2), (1, 2, None), (None, None, None)], "a int, b int, c int")
    said = keys.select(changelog.message_key("d", "t", [F.col(c) for c in "abc"], F.lit("x")).alias("k"))
    assert [r.k for r in said.collect()] == ["d.t.1_\\N_2", "d.t.1_2_\\N", "x"]


def test_decimals_are_compared_as_decimals(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(Decimal("0.1000000000000000001"),), (Decimal("0.1"),)], "v decimal(30,19)")
    assert [r.v for r in columns.keep_rows(df, "v|>|0.1").collect()] == [Decimal("0.1000000000000000000")]


def test_configured_filters(spark):
    def kept(df, rules: str):
        return columns.keep_rows(df, rules)

    def first(df, n: int, wanted: bool = True):
        return df.where(f"id < {n}") if wanted else df

    known = {"rules": kept, "first": first}
    settings = {"filters": "b, a", "filter.a.class": "rules", "filter.a.rules": "id|=|3", "filter.a.priority": "5", "filter.b.class": "first", "filter.b.n": "6", "filter.b.wanted": "true"}
    out, told = columns.chained(spark.range(10), columns.configured_filters(settings, known))
    assert [r.id for r in out.orderBy("id").collect()] == [0, 1, 2, 4, 5] and [(k, o.get["passed"]) for k, o in told.items()] == [("a", 9), ("b", 5)]
    for wrong in ({"filter.b.class": "none"}, {"filter.b.m": "1"}, {"filter.b.n": "x"}, {"filter.b.wanted": "maybe"}):
        with pytest.raises(ValueError, match="filter b"):
            columns.configured_filters(settings | wrong, known)
    assert columns.configured_filters({}, known) == []


def test_channels():
    from tidemark.sources import sinks

    assert [sinks.load_channel(m, t) for m, t in (("AUTO", "mysql"), ("COPY", "PostgreSQL"), ("COPY", "mysql"), ("DIRECT_PATH", "oracle"), ("DIRECT_PATH", "postgresql"))] == [("BATCH", 5000), ("COPY", 5000), ("BATCH", 5000), ("DIRECT_PATH", 5000), ("BATCH", 5000)]
    assert sinks.load_channel("COPY", "postgresql", enabled=False) == ("BATCH", 1) and sinks.load_channel("BATCH", "x", rows=7) == ("BATCH", 7)
    assert types.map_type("pg", "mysql", "oid") == "BIGINT" and types.map_type("pg", "mysql", "bit varying(9)") == "VARCHAR(9)" and types.map_type("pg", "mysql", "bit(3)") == "BIT(3)"
