"""What a catalog says about a copy before it begins: missing objects, tables without key, columns, parents and names in the way.

Catalogs are frames as ``information_schema`` has them, read over JDBC or derived: tables (db, table), columns (db, table,
column, nullable), keys (db, table, key, kind, column; kind is PRIMARY or UNIQUE), parents (db, table, parent_db, parent_table).
A selection is (db, table, target_db, target_table), with a null table for a whole database. Names of tables and columns
are compared in any case. Every check is joins and aggregates; none asks a catalog table by table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Objects that a line of the report names; all are counted.
NAMED = 20


def _lower(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({f"_{c}": F.lower(c) for c in names})


def _full(*names: str) -> Column:
    return F.concat_ws(".", *names)


def selected_tables(selection: DataFrame, tables: DataFrame) -> DataFrame:
    """(db, table, target_db, target_table) of every existing table that is selected, by name or with its database."""
    named = _lower(selection.where("table IS NOT NULL"), "table").join(_lower(tables, "table").select("db", "_table"), ["db", "_table"], "left_semi").select("db", "table", "target_db", "target_table")
    whole = selection.where("table IS NULL").select("db", "target_db").distinct().join(tables, "db").select("db", "table", "target_db", F.col("table").alias("target_table"))
    return named.unionByName(whole)


def missing_objects(selection: DataFrame, tables: DataFrame) -> DataFrame:
    """(object) for selected databases and tables that aren't there."""
    no_db = selection.join(tables.select("db").distinct(), "db", "left_anti").select(F.col("db").alias("object")).distinct()
    named = _lower(selection.where("table IS NOT NULL"), "table").join(tables.select("db").distinct(), "db", "left_semi")
    return no_db.union(named.join(_lower(tables, "table").select("db", "_table"), ["db", "_table"], "left_anti").select(_full("db", "table")))


def without_key(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """(db, table) of those of ``tables`` that have no primary key."""
    primary = _lower(keys.where("kind = 'PRIMARY'"), "table").select("db", "_table").distinct()
    return _lower(tables.select("db", "table"), "table").join(primary, ["db", "_table"], "left_anti").select("db", "table")


def not_replicable(tables: DataFrame, keys: DataFrame, columns: DataFrame) -> DataFrame:
    """(db, table) of tables without a primary key that have no unique key either of columns that are never null."""
    of = _lower(columns, "table", "column").select("db", "_table", "_column", "nullable")
    whole = _lower(keys.where("kind = 'UNIQUE'"), "table", "column").join(of, ["db", "_table", "_column"], "left").groupBy("db", "_table", "key").agg(F.max(F.coalesce("nullable", F.lit(True))).alias("open")).where("NOT open")
    return _lower(without_key(tables, keys), "table").join(whole, ["db", "_table"], "left_anti").select("db", "table")


def missing_columns(tables: DataFrame, columns: DataFrame, used: DataFrame) -> DataFrame:
    """(object) for columns that rules use (``used``: db, table, column) and their existing table lacks."""
    there = _lower(tables, "table").select("db", "_table").distinct()
    return _lower(used, "table", "column").join(there, ["db", "_table"], "left_semi").join(_lower(columns, "table", "column").select("db", "_table", "_column"), ["db", "_table", "_column"], "left_anti").select(_full("db", "table", "column").alias("object"))


def parents_out_of_scope(chosen: DataFrame, selection: DataFrame, parents: DataFrame) -> DataFrame:
    """(object) for each foreign key of a chosen table whose parent isn't chosen, nor its whole database."""
    own = _lower(parents, "table").join(_lower(chosen, "table").select("db", "_table").distinct(), ["db", "_table"], "left_semi").withColumn("_p", F.lower("parent_table"))
    inside = _lower(chosen, "table").select(F.col("db").alias("parent_db"), F.col("_table").alias("_p")).distinct()
    whole = selection.where("table IS NULL").select(F.col("db").alias("parent_db")).distinct()
    out = own.join(inside, ["parent_db", "_p"], "left_anti").join(whole, "parent_db", "left_anti")
    return out.select(F.concat(_full("db", "table"), F.lit(" -> "), _full("parent_db", "parent_table")).alias("object")).distinct()


def names_taken(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(object) for target names that are there already, or that several chosen tables would take."""
    names = chosen.select(F.col("target_db").alias("db"), F.lower("target_table").alias("_table"), F.col("target_table").alias("table"))
    there = names.join(_lower(targets, "table").select("db", "_table").distinct(), ["db", "_table"], "left_semi")
    shared = names.groupBy("db", "_table").agg(F.count("*").alias("n"), F.min("table").alias("table")).where("n > 1")
    return there.select(_full("db", "table").alias("object")).union(shared.select(_full("db", "table"))).distinct()


def precheck(selection: DataFrame, tables: DataFrame, columns: DataFrame, keys: DataFrame, parents: DataFrame, targets: DataFrame, used: DataFrame, capture: str = "rows") -> DataFrame:
    """(check, status, n, objects) for each check: PASS, WARNING or FAIL, the number of objects and the first of their names.

    ``capture`` says how changes are captured: by whole ``rows``, where a table without key is a warning, or by ``keys``, where a
    table without a primary key and without a unique key that is never null fails, as its changes would never come.
    """
    chosen = selected_tables(selection, tables)
    full = lambda df: df.select(_full("db", "table").alias("object"))
    checks = [
        ("source_objects", "FAIL", missing_objects(selection, tables)),
        ("keys", "FAIL", full(not_replicable(chosen, keys, columns))) if capture == "keys" else ("keys", "WARNING", full(without_key(chosen, keys))),
        ("rule_columns", "FAIL", missing_columns(tables, columns, used)), ("parents", "WARNING", parents_out_of_scope(chosen, selection, parents)), ("target_names", "WARNING", names_taken(chosen, targets)),
    ]

    def line(name: str, worst: str, found: DataFrame) -> DataFrame:
        first = found.orderBy("object").limit(NAMED).select("object", F.lit(0).cast("bigint").alias("n"))
        both = first.unionByName(found.agg(F.count("*").alias("n")).select(F.lit(None).cast("string").alias("object"), "n"))
        x = both.agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("object")), ", ").alias("objects"))
        return x.select(F.lit(name).alias("check"), F.when(F.col("n") > 0, worst).otherwise("PASS").alias("status"), "n", "objects")

    return reduce(DataFrame.unionByName, [line(*c) for c in checks])
