"""Column and table definitions from a catalog's columns."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidemark.functions import definitions, types

KINDS = {
    ("mysql", "pg"): ["tinyint(1)", "tinyint(1) unsigned", "TINYINT", "smallint unsigned", "mediumint(8) unsigned", "int(10) unsigned zerofill", "int", "integer", "bigint(20) unsigned", "bigint", "float(7,3)", "double(10,2) unsigned", "decimal(10,2)", "decimal(5)", "decimal", "numeric(4,0)", "varchar(20)", "varchar", "char", "char(3)", "text", "longblob", "varbinary(9)", "datetime(6)", "timestamp", "date", "time(3)", "year(4)", "bit(1)", "bit", "bit(8)", "enum('a','b(3)')", "set('unsigned')", "json", "bool", "geometry", ""],
    ("pg", "mysql"): ["numeric(10,2)", "numeric(6)", "decimal", "character varying(9)", "varchar", "character(4)", "bpchar", "bit varying(7)", "bit(3)", "bit", "int4[]", "text[3]", "serial", "bigserial", "int8", "bool", "double precision", "money", "timestamp(3) without time zone", "timestamptz(6)", "time with time zone", "jsonb", "uuid", "macaddr8", "inet", "oid", "jsonb_ext", "strange", ""],
    ("oracle", "pg"): ["NUMBER", "NUMBER(4)", "NUMBER(9,0)", "NUMBER(18)", "NUMBER(38)", "NUMBER(10,2)", "NUMBER(3,-2)", "VARCHAR2(30 CHAR)", "NVARCHAR2", "CHAR", "NCHAR(2)", "DATE", "TIMESTAMP(6)", "TIMESTAMP(6) WITH TIME ZONE", "TIMESTAMP WITH LOCAL TIME ZONE", "CLOB", "LONG RAW", "LONG", "RAW(16)", "FLOAT(126)", "BINARY_DOUBLE", "INTERVAL DAY(2) TO SECOND(6)", "ROWID", "XMLTYPE", "JSON", "SDO_GEOMETRY", ""],
}


@pytest.mark.parametrize("way", KINDS)
def test_expressions_map_like_the_function(spark, way):
    rows = spark.createDataFrame([(k,) for k in [*KINDS[way], None]], "k string")
    got = {r.k: r.to for r in rows.select("k", definitions.mapped_type(*way, F.col("k")).alias("to")).collect()}
    assert got == {k: types.map_type(*way, k) for k in got}


def said(spark, source, target, cells, **more):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "i int, kind string, nullable boolean, value string, auto boolean")
    return [r.d for r in rows.select("i", definitions.column_definition(source, target, F.col("kind"), F.col("nullable"), F.col("value"), F.col("auto"), **more).alias("d")).orderBy("i").collect()]


def test_from_mysql(spark):
    cases = {
        ("bigint unsigned", False, None, True): "NUMERIC(20,0) NOT NULL", ("int", False, "7", True): "INTEGER NOT NULL", ("int", True, "-7", False): "INTEGER DEFAULT -7", ("varchar(9)", True, "it's", None): "VARCHAR(9) DEFAULT 'it''s'",
        ("varchar(9)", None, "'x'", None): "VARCHAR(9) DEFAULT 'x'", ("tinyint(1)", False, "1", False): "BOOLEAN NOT NULL DEFAULT TRUE", ("tinyint(1)", True, "0", False): "BOOLEAN DEFAULT FALSE", ("bit(1)", True, "b'1'", False): "BOOLEAN DEFAULT TRUE",
        ("bit(8)", True, "b'101'", False): "BYTEA", ("datetime(6)", False, "CURRENT_TIMESTAMP(6)", False): "TIMESTAMP NOT NULL DEFAULT CURRENT_TIMESTAMP", ("timestamp", True, "now()", False): "TIMESTAMP DEFAULT CURRENT_TIMESTAMP",
        ("time", True, "NULL", False): "INTERVAL", ("int", True, "", False): "INTEGER", ("tinyint", True, "1", False): "SMALLINT DEFAULT 1", ("decimal(5,2)", True, "1.50", False): "NUMERIC(5,2) DEFAULT 1.50",
        ("enum('a','b')", False, "a", False): "VARCHAR(255) NOT NULL DEFAULT 'a'", (None, False, "5", True): "TEXT", ("varchar(36)", True, "uuid()", False): "VARCHAR(36)",
    }
    assert said(spark, "mysql", "pg", cases) == list(cases.values())
    assert said(spark, "mysql", "pg", [("int", False, None, True), ("int", False, "1", False)], identity=True) == ["INTEGER NOT NULL GENERATED BY DEFAULT AS IDENTITY", "INTEGER NOT NULL DEFAULT 1"]


def test_from_pg(spark):
    cases = {
        ("serial", False, "nextval('t_id_seq'::regclass)", False): "INT NOT NULL AUTO_INCREMENT", ("bigserial", True, None, None): "BIGINT AUTO_INCREMENT", ("int4", False, "nextval('s'::regclass)", False): "INT NOT NULL", ("int4", False, "nextval('s'::regclass)", True): "INT NOT NULL AUTO_INCREMENT",
        ("varchar(5)", True, "'a''b'::character varying", False): "VARCHAR(5) DEFAULT 'a''b'", ("numeric(8,3)", True, "(0)::numeric(8,3)", False): "DECIMAL(8,3) DEFAULT 0", ("text", True, "NULL::character varying", False): "TEXT",
        ("bool", False, "true", False): "TINYINT(1) NOT NULL DEFAULT 1", ("boolean", True, "'f'::boolean", False): "TINYINT(1) DEFAULT 0", ("timestamptz", False, "now()", False): "DATETIME NOT NULL DEFAULT CURRENT_TIMESTAMP",
        ("timestamp", True, "timezone('utc'::text, now())", False): "DATETIME DEFAULT CURRENT_TIMESTAMP", ("timestamp", True, "date_trunc('day'::text, now())", False): "DATETIME DEFAULT CURRENT_TIMESTAMP", ("date", True, "CURRENT_DATE", False): "DATE DEFAULT (CURRENT_DATE)",
        ("jsonb", False, "'{}'::jsonb", False): "JSON NOT NULL DEFAULT ('{}')", ("text", True, "'n'::text", False): "TEXT DEFAULT ('n')", ("uuid", False, "gen_random_uuid()", False): "CHAR(36) NOT NULL DEFAULT (UUID())", ("int8", True, "my_function(3)", False): "BIGINT",
        ("varchar", True, "word", False): "VARCHAR(255) DEFAULT 'word'", ("int4[]", True, "'{}'::integer[]", False): "TEXT DEFAULT ('{}')",
    }
    assert said(spark, "pg", "mysql", cases) == list(cases.values())


def test_from_oracle(spark):
    cases = {
        ("NUMBER(9)", False, "0 ", False): "INTEGER NOT NULL DEFAULT 0", ("DATE", True, "SYSDATE", False): "TIMESTAMP DEFAULT CURRENT_TIMESTAMP", ("TIMESTAMP(6) WITH TIME ZONE", True, "systimestamp", False): "TIMESTAMPTZ DEFAULT CURRENT_TIMESTAMP",
        ("RAW(16)", True, "SYS_GUID()", False): "BYTEA", ("VARCHAR2(30)", True, "USER", False): "VARCHAR(30) DEFAULT CURRENT_USER", ("VARCHAR2(3)", True, "N'ab'", False): "VARCHAR(3) DEFAULT 'ab'", ("NUMBER", True, "SEQ.NEXTVAL", False): "NUMERIC", ("CHAR(1)", True, "null", False): "CHAR(1)",
    }
    assert said(spark, "oracle", "pg", cases) == list(cases.values())


def test_tables(spark):
    columns = [
        ("app.t`1", 2, "b", "varchar(3)", True, "x", False, 2), ("app.t`1", 1, "a", "int", False, None, True, 1), ("app.t`1", 3, 'odd"', "text", True, None, False, None), ("plain", 1, "n", "json", True, None, None, None), ("none", None, None, None, None, None, None, None),
    ]
    kept = spark.createDataFrame(columns, "table string, position int, name string, type string, nullable boolean, default string, auto boolean, key int")
    made = {r.table: r.sql for r in definitions.table_definitions(kept.where("name IS NOT NULL"), "mysql", "pg").collect()}
    assert made == {"app.t`1": 'CREATE TABLE IF NOT EXISTS "app"."t`1" ("a" INTEGER NOT NULL, "b" VARCHAR(3) NOT NULL DEFAULT \'x\', "odd""" TEXT, PRIMARY KEY ("a", "b"))', "plain": 'CREATE TABLE IF NOT EXISTS "plain" ("n" JSONB)'}
    assert definitions.table_definitions(kept.limit(0), "mysql", "pg").collect() == []
    with pytest.raises(ValueError, match="no map"):
        definitions.table_definitions(kept, "oracle", "mysql")


def test_every_way_is_tested():
    assert {w for w in itertools.product(("mysql", "pg", "oracle"), ("mysql", "pg")) if w[0] != w[1]} - set(KINDS) == {("oracle", "mysql")}
