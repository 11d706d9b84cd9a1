"""Statements as tokens: classes, tables, keys, lists, redo and shadow tables, each expectation written out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ddl, lexer, lists, statements


def every(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, sql string")
    return [tuple(r) if len(r) > 1 else r[0] for r in df.orderBy("i").select(*columns).collect()]


LONG = "x" * 200_000 + "''\\'" * 30_000
#: statement, class, kind, database, table, what it conflicts with, what becomes of it when a schema tool runs
STATEMENTS = [
    ("CREATE TABLE t1 (id INT PRIMARY KEY, name VARCHAR(50))", "DDL", "CREATE_TABLE", "", "t1", "t1:*", "PASS"),
    ("CREATE TABLE IF NOT EXISTS `my db`.`t.1` (id INT)", "DDL", "CREATE_TABLE", "my db", "t.1", "my db.t.1:*", "PASS"),
    ("/*!50001 CREATE TABLE a.b (id int) */", "DDL", "CREATE_TABLE", "a", "b", "a.b:*", "PASS"),
    ("create temporary table tmp (a int)", "DDL", "CREATE_TABLE", "", "tmp", "tmp:*", "PASS"),
    ("ALTER TABLE t1 ADD COLUMN age INT", "DDL", "ALTER_TABLE", "", "t1", "t1:*", "PASS"),
    ("alter /* c */ table `test1`.`t5` add index i (a)", "DDL", "ALTER_TABLE", "test1", "t5", "test1.t5:*", "PASS"),
    ("ALTER TABLE ONLY public.x ADD y int", "DDL", "ALTER_TABLE", "public", "x", "public.x:*", "PASS"),
    ("DROP TABLE IF EXISTS test1.t1, t2", "DDL", "DROP_TABLE", "test1", "t1", "test1.t1:*", "PASS"),
    ("TRUNCATE TABLE t1", "DDL", "TRUNCATE_TABLE", "", "t1", "t1:*", "PASS"),
    ("truncate a.b", "DDL", "TRUNCATE_TABLE", "a", "b", "a.b:*", "PASS"),
    ("RENAME TABLE a.t1 TO a.t2, b.t3 TO b.t4", "DDL", "RENAME_TABLE", "a", "t1", "a.t1:*", "PASS"),
    ("CREATE INDEX i ON db1.t (a)", "DDL", "CREATE_INDEX", "db1", "t", "db1.t:*", "PASS"),
    ("CREATE UNIQUE INDEX `on` USING BTREE ON db1.t (a)", "DDL", "CREATE_INDEX", "db1", "t", "db1.t:*", "PASS"),
    ("CREATE INDEX ON t (a)", "DDL", "CREATE_INDEX", "", "t", "t:*", "PASS"),
    ("DROP INDEX i ON db1.t", "DDL", "DROP_INDEX", "db1", "t", "db1.t:*", "PASS"),
    ("DROP INDEX IF EXISTS db1.i", "DDL", "DROP_INDEX", "db1", "", "", "PASS"),
    ("CREATE DATABASE IF NOT EXISTS `d 1`", "DDL", "CREATE_DATABASE", "d 1", "", "", "PASS"),
    ("ALTER SCHEMA d CHARACTER SET utf8", "DDL", "ALTER_DATABASE", "d", "", "", "PASS"),
    ("DROP DATABASE test_db", "DDL", "DROP_DATABASE", "test_db", "", "", "PASS"),
    ("CREATE OR REPLACE ALGORITHM=MERGE DEFINER=`r`@`%` SQL SECURITY INVOKER VIEW d.v AS SELECT 1", "DDL", "CREATE_VIEW", "d", "v", "d.v:*", "PASS"),
    ("drop view if exists d.v", "DDL", "DROP_OTHER", "d", "v", "d.v:*", "PASS"),
    ("CREATE DEFINER=`r`@`localhost` PROCEDURE d.p() BEGIN DELETE FROM x; END", "DDL", "CREATE_ROUTINE", "d", "p", "d.p:*", "PASS"),
    ("CREATE DEFINER = r@localhost FUNCTION f() RETURNS INT RETURN 1", "DDL", "CREATE_ROUTINE", "", "f", "f:*", "PASS"),
    ("CREATE TRIGGER tr BEFORE INSERT ON d.t FOR EACH ROW SET @a = 1", "DDL", "CREATE_TRIGGER", "d", "t", "d.t:*", "PASS"),
    ("CREATE EVENT e ON SCHEDULE EVERY 1 DAY DO DELETE FROM t", "DDL", "CREATE_EVENT", "", "e", "e:*", "PASS"),
    ("GRANT SELECT ON *.* TO u", "DDL", "ACCOUNT", "", "", "", "PASS"),
    ("BEGIN", "TRANSACTION", "BEGIN", "", "", "", "PASS"), ("start  transaction", "TRANSACTION", "BEGIN", "", "", "", "PASS"), ("COMMIT;", "TRANSACTION", "COMMIT", "", "", "", "PASS"),
    ("ROLLBACK", "TRANSACTION", "ROLLBACK", "", "", "", "PASS"), ("SAVEPOINT s", "TRANSACTION", "SAVEPOINT", "", "", "", "PASS"), ("XA START 'x'", "TRANSACTION", "XA", "", "", "", "PASS"),
    ("USE test_db", "USE", "USE", "", "", "", "PASS"),
    ("USE db1; ALTER TABLE t ADD c INT", "DDL", "ALTER_TABLE", "db1", "t", "db1.t:*", "PASS"),
    ("use `db1`;delete from t where id = 3", "DML", "DELETE", "db1", "t", "db1.t:3", "PASS"),
    ("show tables", "OTHER", "OTHER", "", "", "", "PASS"), ("", "OTHER", "OTHER", "", "", "", "PASS"), (None, "OTHER", "OTHER", "", "", "", "PASS"), ("-- only\n/* talk */ # here", "OTHER", "OTHER", "", "", "", "PASS"),
    ("SET x = 'create table a'", "OTHER", "OTHER", "", "", "", "PASS"),
    ("INSERT INTO mydb.t1 (id, v) VALUES (1, 'a')", "DML", "INSERT", "mydb", "t1", "mydb.t1:1", "PASS"),
    ("INSERT t (v, ID) VALUES ('id = 9', 5)", "DML", "INSERT", "", "t", "t:5", "PASS"),
    ("insert ignore into `t` (`v`, `id`) values (concat('a,', f(1, 2)), 'K-7')", "DML", "INSERT", "", "t", "t:k-7", "PASS"),
    ("INSERT INTO t (id, v) VALUES (1, 2), (3, 4)", "DML", "INSERT", "", "t", "t:*", "PASS"),
    ("INSERT INTO t VALUES (1, 2)", "DML", "INSERT", "", "t", "t:*", "PASS"), ("INSERT INTO t (id) SELECT id FROM u", "DML", "INSERT", "", "t", "t:*", "PASS"),
    ("INSERT INTO t (id, v) VALUES (1, 2) ON DUPLICATE KEY UPDATE v = 3", "DML", "INSERT", "", "t", "t:*", "PASS"), ("INSERT INTO t (id, v) VALUES (uuid(), 2)", "DML", "INSERT", "", "t", "t:*", "PASS"),
    ("INSERT INTO t SET v = '),(', id = -7", "DML", "INSERT", "", "t", "t:-7", "PASS"), ("REPLACE INTO t (id) VALUES (007)", "DML", "REPLACE", "", "t", "t:7", "PASS"),
    ("UPDATE t SET x='where id = 5' WHERE id = 7", "DML", "UPDATE", "", "t", "t:7", "PASS"), ("update `db2`.`users` set v = 2 where id = '007'", "DML", "UPDATE", "db2", "users", "db2.users:7", "PASS"),
    ("UPDATE t SET v = 1 WHERE id = 1 OR id = 2", "DML", "UPDATE", "", "t", "t:*", "PASS"), ("UPDATE t SET v = 1 WHERE (a = 1 OR b = 2) AND `t`.`id` = 5 LIMIT 1", "DML", "UPDATE", "", "t", "t:5", "PASS"),
    ("UPDATE t SET v = 1 WHERE (id = 5)", "DML", "UPDATE", "", "t", "t:5", "PASS"), ("UPDATE t SET id = 9 WHERE id = 7", "DML", "UPDATE", "", "t", "t:*", "PASS"),
    ("UPDATE t SET v = (SELECT id FROM u WHERE id = 3) WHERE id = 4", "DML", "UPDATE", "", "t", "t:4", "PASS"), ("UPDATE t SET v = 1 WHERE x BETWEEN 1 AND id = 5", "DML", "UPDATE", "", "t", "t:*", "PASS"),
    ("UPDATE t SET v = 1 WHERE id = other", "DML", "UPDATE", "", "t", "t:*", "PASS"), ("UPDATE t SET v = 1 WHERE NOT id = 5", "DML", "UPDATE", "", "t", "t:*", "PASS"),
    ("UPDATE t SET v = 1 WHERE id = 5 + 1", "DML", "UPDATE", "", "t", "t:*", "PASS"), ("UPDATE t SET v = 1", "DML", "UPDATE", "", "t", "t:*", "PASS"),
    ("UPDATE a, b SET a.v = 1 WHERE a.id = 5", "DML", "UPDATE", "", "a", "*", "PASS"), ("UPDATE a JOIN b ON a.x = b.x SET a.v = 1 WHERE a.id = 5", "DML", "UPDATE", "", "a", "*", "PASS"),
    ("DELETE FROM orders WHERE id = 'it''s \\'so\\''", "DML", "DELETE", "", "orders", "orders:it's 'so'", "PASS"), ("DELETE a FROM a JOIN b ON a.x = b.x WHERE a.id = 5", "DML", "DELETE", "", "", "*", "PASS"),
    ("delete from a.b where id=7", "DML", "DELETE", "a", "b", "a.b:7", "PASS"), ("DELETE FROM t WHERE kid = 7", "DML", "DELETE", "", "t", "t:*", "PASS"), ("DELETE FROM t WHERE id = 7 -- and id = 8", "DML", "DELETE", "", "t", "t:7", "PASS"),
    ("UPDATE t SET v = 'open WHERE id = 3", "DML", "UPDATE", "", "t", "t:*", "PASS"), ("DELETE FROM t WHERE id = 7 AND (a = 1", "DML", "DELETE", "", "t", "t:*", "PASS"),
    (f"UPDATE t SET v = '{LONG}' WHERE id = 8", "DML", "UPDATE", "", "t", "t:8", "PASS"),
    ("CREATE TABLE `d`.`_t_gho` (id INT, n INT)", "DDL", "CREATE_TABLE", "d", "_t_gho", "d._t_gho:*", "ALTER"), ("CREATE TABLE _t_new (id INT)", "DDL", "CREATE_TABLE", "", "_t_new", "_t_new:*", "ALTER"),
    ("ALTER TABLE _t_gho ADD COLUMN n INT", "DDL", "ALTER_TABLE", "", "_t_gho", "_t_gho:*", "SKIP"), ("CREATE TABLE _t_ghc (id INT)", "DDL", "CREATE_TABLE", "", "_t_ghc", "_t_ghc:*", "SKIP"),
    ("INSERT INTO _t_gho (id) VALUES (1)", "DML", "INSERT", "", "_t_gho", "_t_gho:1", "SKIP"), ("CREATE INDEX i ON _t_gho (id)", "DDL", "CREATE_INDEX", "", "_t_gho", "_t_gho:*", "SKIP"),
    ("RENAME TABLE t TO _t_del, _t_gho TO t", "DDL", "RENAME_TABLE", "", "t", "t:*", "SKIP"), ("DROP TABLE IF EXISTS _t_del", "DDL", "DROP_TABLE", "", "_t_del", "_t_del:*", "SKIP"),
    ("INSERT INTO t (id, s) VALUES (1, '_t_gho')", "DML", "INSERT", "", "t", "t:1", "PASS"),
]


def test_statements(spark):
    sql = F.col("sql")
    kind, sub = statements.classify(sql)
    db, name = statements.table_of(sql)
    got = every(spark, [s[0] for s in STATEMENTS], kind, sub, db, name, statements.conflict_key(sql), statements.online_change(sql))
    wrong = [(s[0] and s[0][:80], s[1:], g) for s, g in zip(STATEMENTS, got, strict=True) if s[1:] != g]
    assert not wrong and len(STATEMENTS) >= 60


def test_keys_named_by_table(spark):
    texts = ["INSERT INTO t (a, uid) VALUES (1, 2)", "UPDATE s.T SET a = 1 WHERE UID = 4", "DELETE FROM u WHERE uid = 4 AND id = 6"]
    assert every(spark, texts, statements.conflict_key(F.col("sql"), keys={"T": "uid"})) == ["t:2", "s.T:4", "u:6"]


def test_affected_tables(spark):
    cases = [
        ("ALTER TABLE test1.t5 ADD COLUMN name VARCHAR(30)", ["test1.t5"]), ("ALTER TABLE t5 ADD COLUMN a INT", ["cur.t5"]), ("DROP TABLE IF EXISTS test1.t1, t2, db2.t3", ["test1.t1", "cur.t2", "db2.t3"]),
        ("DROP TABLE a.t1, a.t2 CASCADE", ["a.t1", "a.t2"]), ("TRUNCATE TABLE test1.t5", ["test1.t5"]), ("CREATE TABLE IF NOT EXISTS test1.t5 (id INT PRIMARY KEY, b SET('a, b'))", ["test1.t5"]),
        ("RENAME TABLE a.t1 TO a.t2, `b`.`t3` TO b.t4", ["a.t1", "a.t2", "b.t3", "b.t4"]), ("RENAME TABLE a.t1 TO t2", ["a.t1", "cur.t2"]), ("CREATE DATABASE test1", []), ("CREATE INDEX idx ON test1.t5 (id)", []),
        ("INSERT INTO test1.t5 VALUES (1, 'x')", []), (None, []), ("   ", []), ("use z; drop table q", ["z.q"]),
    ]
    assert every(spark, [c[0] for c in cases], statements.affected_tables(F.col("sql"), F.lit("cur"))) == [c[1] for c in cases]


def test_rows_of_values(spark):
    cases = [("1, 'a,b', NULL, -2.50", ["1", "a,b", None, "-2.50"]), ("(1,'it''s (so)','\\\\',f(1,(2)))", ["1", "it's (so)", "\\", "f(1, (2))"]), ("('')", [""]), ("(1,'open", None), ("(1", None), ("to_date('2020-01-02', 'YYYY-MM-DD')", ["2020-01-02"]), (f"'{LONG}'", [LONG.replace("''", "'").replace("\\'", "'")])]
    assert every(spark, [c[0] for c in cases], lists.row_values(F.col("sql"))) == [c[1] for c in cases]
    deep = "(" * 40 + "1" + ")" * 40
    assert every(spark, [deep], lists.row_values(F.col("sql"))) == [None]
    image = lists.row_image(F.col("sql"), F.array(F.lit("id"), F.lit("day"), F.lit("n")))
    got = every(spark, ["1,'2020-01-02',x", "1,2"], image["image"], image["raw"], lists.typed_row(image["image"], {"id": "int", "day": "date", "n": "int"}))
    assert got[0][:2] == ({"id": "1", "day": "2020-01-02", "n": "x"}, None) and tuple(got[0][2]) == (1, dt.date(2020, 1, 2), None)
    assert got[1][:2] == (None, "1,2")


def test_array_literals(spark):
    cases = [('{1,NULL,"a,b"," x ","NULL","q\\"\\\\"}', ["1", None, "a,b", " x ", "NULL", 'q"\\']), ("{}", []), (" { a , b } ", ["a", "b"]), ('{{1,"}"},{3,4}}', ['{1,"}"}', "{3,4}"]), ("[0:1]={7,8}", ["7", "8"]), ("{1,,2}", None), ("{1", None), ("1,2", None), (None, None), ('{"open}', None), ("{" + ",".join(map(str, range(50_000))) + "}", [str(i) for i in range(50_000)])]
    assert every(spark, [c[0] for c in cases], lists.array_values(F.col("sql"))) == [c[1] for c in cases]
    assert every(spark, ["{1,x,NULL,-3}"], lists.array_values(F.col("sql"), "int")) == [[1, None, None, -3]]


def test_redo(spark):
    cases = [
        ("""insert into "S"."T"("ID","N","D") values ('1','it''s, ok',TO_DATE('2020-01-02', 'YYYY-MM-DD'));""", ("c", "S", "T", None, {"ID": "1", "N": "it's, ok", "D": "2020-01-02"}, None)),
        ("""update "S"."T" set "N" = 'C:\\', "D" = NULL where "ID" = '1' and "N" = 'x and y' and "D" IS NULL and ROWID = 'AAA';""", ("u", "S", "T", {"ID": "1", "N": "x and y", "D": None}, {"ID": "1", "N": "C:\\", "D": None}, None)),
        ("""delete from "S"."T" where "ID" = '7' and "N" IS NULL and ROWID = 'AAB';""", ("d", "S", "T", {"ID": "7", "N": None}, None, None)),
        ("""insert into "S"."T"("ID","N") values ('1');""", (None, None, None, None, None, """insert into "S"."T"("ID","N") values ('1');""")),
        ("Unsupported", (None, None, None, None, None, "Unsupported")),
        ("""insert into "S"."T"("A","B") values (HEXTORAW('c1'),EMPTY_CLOB());""", ("c", "S", "T", None, {"A": "c1", "B": ""}, None)),
    ]
    r = lists.redo_change(F.col("sql"))
    assert every(spark, [c[0] for c in cases], *[r[c] for c in ("op", "db", "name", "before", "after", "raw")]) == [c[1] for c in cases]


def test_column_changes(spark):
    cases = [
        ("CREATE TABLE t (id INT, `a,b` DECIMAL(10,2) DEFAULT '(,', PRIMARY KEY (id, `a,b`), KEY k (id))", [("create", "id", None, None), ("create", "a,b", None, None)]),
        ("ALTER TABLE t ADD COLUMN c ENUM('x,y','z') AFTER id, DROP a, RENAME COLUMN `b` TO c2, ADD KEY k (c)", [("add", "c", None, "id"), ("drop", "a", None, None), ("rename", "b", "c2", None)]),
        ("ALTER TABLE t ADD (p INT, q INT), CHANGE x y INT FIRST, MODIFY z BIGINT AFTER y, MODIFY w INT", [("add", "p", None, None), ("add", "q", None, None), ("rename", "x", "y", None), ("move", "y", None, ""), ("move", "z", None, "y")]),
        ("ALTER TABLE t ADD d INT FIRST, DROP PRIMARY KEY, ADD CONSTRAINT c CHECK (d > 0), DROP COLUMN IF EXISTS e CASCADE", [("add", "d", None, ""), ("drop", "e", None, None)]),
        ("DROP TABLE t", [("gone", None, None, None)]), ("TRUNCATE t", []), ("CREATE TABLE t LIKE u", []),
    ]
    assert [[tuple(c) for c in x] for x in every(spark, [c[0] for c in cases], lists.column_changes(F.col("sql")))] == [c[1] for c in cases]


def test_shadow_tables(spark):
    old = "CREATE TABLE t (id INT NOT NULL, a VARCHAR(10) DEFAULT 'x,y', b INT, KEY ka (a), PRIMARY KEY (id))"
    cases = [
        ("CREATE TABLE `_t_gho` (`id` INT NOT NULL, a VARCHAR(20) DEFAULT 'x,y', c ENUM('p','q'), b INT, PRIMARY KEY (id), UNIQUE KEY kb (b))", "ALTER TABLE `d`.`t` DROP KEY `ka`, MODIFY COLUMN `a` VARCHAR(20) DEFAULT 'x,y', ADD COLUMN `c` ENUM('p', 'q') AFTER `a`, ADD UNIQUE KEY kb(b)"),
        ("CREATE TABLE _t_gho (id INT NOT NULL, a VARCHAR(10) DEFAULT 'x,y', KEY ka (a), PRIMARY KEY (id))", "ALTER TABLE `d`.`t` DROP COLUMN `b`"),
        ("CREATE TABLE _t_gho (id INT NOT NULL, a2 VARCHAR(10) DEFAULT 'x,y', b INT, KEY ka (a), PRIMARY KEY (id))", "ALTER TABLE `d`.`t` RENAME COLUMN `a` TO `a2`"),
        ("CREATE TABLE _t_gho (z INT, id INT NOT NULL, a VARCHAR(10) DEFAULT 'x,y', b INT, KEY ka (a), PRIMARY KEY (id))", "ALTER TABLE `d`.`t` ADD COLUMN `z` INT FIRST"),
        (old.replace(" t ", " _t_new "), None), ("CREATE TABLE _t_gho LIKE t", None),
    ]
    assert every(spark, [c[0] for c in cases], lists.shadow_change(F.col("sql"), F.lit(old), F.lit("`d`.`t`"))) == [c[1] for c in cases]


@pytest.mark.parametrize(
    ("text", "names", "want"),
    [
        ("SELECT users.id, 'users.id' FROM users JOIN shop.users ON users.id = 5", {"users": "people"}, "SELECT people.id, 'users.id' FROM people JOIN shop.users ON people.id = 5"),
        ("DELETE FROM shop.users WHERE shop.users.id = 1 AND `users`.`v` = 2", {"shop.users": "dw.people"}, "DELETE FROM dw.people WHERE dw.people.id = 1 AND people.`v` = 2"),
        ("SELECT users.id FROM other AS users", {"users": "people"}, "SELECT users.id FROM other AS users"),
        ("SELECT * FROM users.x", {"users": "people"}, "SELECT * FROM users.x"),
    ],
)
def test_qualifiers_are_renamed_too(spark, text, names, want):
    assert every(spark, [text], ddl.renamed(F.col("sql"), names)) == [want]


def test_long_literals_cost_no_stack(spark):
    assert every(spark, [f"UPDATE t SET v = '{LONG}'"], ddl.renamed(F.col("sql"), {"t": "u"})) == [f"UPDATE u SET v = '{LONG}'"]
    assert len(every(spark, ["INSERT INTO t VALUES " + ",".join(f"({i},'a{i}')" for i in range(30_000))], lexer.tokens(F.col("sql")))[0]) == 4 + 30_000 * 6 - 1


def test_rewrites_grow_with_their_rules(spark):
    """Every name adds its rules once: three names more don't multiply the plan."""
    size = lambda n: len(spark.range(1).select(ddl.renamed(F.col("id").cast("string"), {f"d.t{i}": f"e.u{i}" for i in range(n)}))._jdf.queryExecution().analyzed().toString())
    assert size(4) - size(3) < 2 * (size(2) - size(1))
    text = F.concat(F.col("id").cast("string"), F.lit("marked"))
    assert spark.range(1).select(ddl.translated(text, "mysql", "pg").alias("sql"))._jdf.queryExecution().analyzed().toString().count("marked") == 1
