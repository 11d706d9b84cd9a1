"""Nested documents as variants: their paths and values, rules over paths, and differences by path."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How deep documents are opened; what lies deeper is compared as one value.
DEEP = 16


def document(text: Column) -> Column:
    """A document from its text; null where it is none."""
    return F.try_parse_json(text)


def _told(path: Column, v: Column, is_open: bool) -> Column:
    return F.struct(path.alias("path"), v.alias("v"), F.lit(is_open).alias("open"))


def _named(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``x``, which stands once in it, however often it is used: else levels within levels would double each time."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _opened(x: Column, dot: str) -> Column:
    """What lies right in one object or array; the thing itself as a leaf where it is none or empty."""
    fields = F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), lambda e: _told(F.concat(x["path"], F.lit(dot), F.regexp_replace(e["key"], r"([.\[\]\\])", r"\\$1")), e["value"], True))
    items = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda v, i: _told(F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")), v, True))
    return _named(F.coalesce(fields, items), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(_told(x["path"], x["v"], False))))


def leaves(doc: Column, deep: int = DEEP) -> Column:
    """An array of path and v, a variant, of every leaf of ``doc`` (see ``document_paths``); a null has none.

    Each level opens the objects and arrays among what it is given, within the row; where none is open, a level costs a look.
    """
    found = F.when(doc.isNotNull(), F.array(_told(F.lit(""), doc, True))).otherwise(F.array().cast("array<struct<path:string,v:variant,open:boolean>>"))
    for level in range(deep):
        each = partial(_opened, dot="." if level else "")
        wider = lambda xs: F.flatten(F.transform(xs, lambda x: F.when(x["open"], each(x)).otherwise(F.array(x))))  # noqa: B023, E731
        found = _named(found, lambda xs: F.when(F.exists(xs, lambda x: x["open"]), wider(xs)).otherwise(xs))  # noqa: B023
    return found


def document_paths(docs: DataFrame, key: str, doc: str, deep: int = DEEP) -> DataFrame:
    """(key, path, value, kind) of every leaf of ``doc``, a variant: paths like ``a.b[0]``, values as JSON text.

    Empty objects and arrays, and what lies ``deep`` levels down, are leaves. The documents are read once, and a document is
    opened within its row.
    """
    rows = docs.where(F.col(doc).isNotNull()).select(F.col(key).alias("_key"), F.inline_outer(leaves(F.col(doc), deep)))
    return rows.select(F.col("_key").alias(key), "path", F.to_json("v").alias("value"), F.regexp_replace(F.schema_of_variant("v"), r"<[\s\S]*$", "").alias("kind"))


def path_excluded(doc: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Whether a document meets any of ``rules`` (path like ``$.a.b[0]``, comparison, value); a path that isn't there or no number meets none.

    Comparisons are =, <>, <, <=, >, >=; where both sides are numbers they are compared as such, else as text.
    """
    out = F.lit(False)
    for path, how, value in rules:
        text = F.try_variant_get(doc, path, "string")
        number, wanted = text.try_cast("decimal(38,10)"), F.lit(value).try_cast("decimal(38,10)")
        order = F.when(number.isNotNull() & wanted.isNotNull(), F.when(number < wanted, -1).when(number > wanted, 1).otherwise(0)).otherwise(F.when(text < value, -1).when(text > value, 1).otherwise(0))
        if how not in ("=", "<>", "<", "<=", ">", ">="):
            raise ValueError(f"no comparison: {how}")
        met = {"=": order == 0, "<>": order != 0, "<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}[how]
        out = out | F.coalesce(F.when(text.isNotNull(), met), F.lit(False))
    return out


def path_diff(source: DataFrame, target: DataFrame, key: str, doc: str, deep: int = DEEP, ignored: tuple[str, ...] = ("_id",)) -> DataFrame:
    """(key, diff_type, paths) of documents that differ: SOURCE_ONLY, TARGET_ONLY, or CONTENT_DIFF with the paths that do, sorted.

    Numbers are compared as numbers (1 and 1.0 are equal), the order of an object's fields doesn't count, an array's does.
    """
    def cells(side: Column) -> Column:
        """Each leaf as the length of its path, the path and its value."""

        def cell(x: Column) -> Column:
            kind, value = F.schema_of_variant(x["v"]), F.to_json(x["v"])
            number = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.concat(F.lit("#"), value.try_cast("decimal(38,10)").cast("string")))
            return F.concat(F.length(x["path"]).cast("string"), F.lit(":"), x["path"], F.coalesce(number, value))

        return F.transform(F.filter(leaves(side, deep), lambda x: ~x["path"].isin(*ignored)), cell)

    pair = source.select(key, F.lit(True).alias("_s"), F.col(doc).alias("_sd")).join(target.select(key, F.lit(True).alias("_t"), F.col(doc).alias("_td")), key, "full_outer")
    # Documents of one text are equal in all their leaves; only the others are opened.
    uneven = F.col("_s") & F.col("_t") & ~F.to_json("_sd").eqNullSafe(F.to_json("_td"))
    # Row by row, so that a leaf is never shuffled; the generator keeps a filter from repeating what it makes.
    told = pair.select(key, "_s", "_t", (F.col("_sd").isNull() != F.col("_td").isNull()).alias("_one"), F.inline_outer(F.array(F.struct(*[F.when(uneven, cells(F.col(d))).alias(c) for d, c in (("_sd", "_sc"), ("_td", "_tc"))]))))
    apart = F.concat(F.array_except("_sc", "_tc"), F.array_except("_tc", "_sc"))
    paths = F.transform(apart, lambda x: F.substring(x, F.instr(x, ":") + 1, F.substring_index(x, ":", 1).cast("int")))
    told = told.select(key, "_s", "_t", "_one", F.inline_outer(F.array(F.struct(F.array_sort(F.array_distinct(paths)).alias("_paths")))))
    kind = F.when(F.col("_t").isNull(), "SOURCE_ONLY").when(F.col("_s").isNull(), "TARGET_ONLY").when((F.size("_paths") > 0) | F.col("_one"), "CONTENT_DIFF")
    return told.select(key, kind.alias("diff_type"), F.coalesce("_paths", F.array().cast("array<string>")).alias("paths")).where("diff_type IS NOT NULL")
