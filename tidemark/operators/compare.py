"""Source against target: counts, fingerprints, row differences and what repairs them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import digest_tree
from .digest_tree import text_of


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """row_count and, of two independent parts of the row digests, sums (as text) and exclusive ors: any order, any partitioning."""
    return df.agg(*digest_tree.totals(digest_tree.row_digest(df, columns))).select(F.col("n").alias("row_count"), F.col("sum_a").cast("string").alias("sum_a"), "xor_a", F.col("sum_b").cast("string").alias("sum_b"), "xor_b")


def slice_counts(sources: list[tuple[str, str, str, DataFrame]], merged: DataFrame) -> DataFrame:
    """source_count, target_count and their difference of each (node, database, table) that was merged: its own slice by the tags.

    The merged table is counted once, for all slices together; slices that are no source's are told too.
    """
    tags = ["src_node", "src_db", "src_table"]
    own = [df.agg(F.count("*").alias("source_count")).withColumns(dict(zip(tags, map(F.lit, (node, db, name)), strict=True))) for node, db, name, df in sources]
    slices = merged.groupBy(*tags).agg(F.count("*").alias("target_count"))
    x = reduce(DataFrame.unionByName, own).join(slices, tags, "full_outer").na.fill(0, ["source_count", "target_count"])
    return x.select(*tags, "source_count", "target_count", F.abs(F.col("source_count") - F.col("target_count")).alias("difference"))


def content_compare(name: str, source: DataFrame, target: DataFrame, pk: list[str] | None, fan: int = digest_tree.FAN, levels: int = digest_tree.LEVELS) -> DataFrame:
    """One row: table_name, source_only, target_only, content_diff and verdict.

    First the digest trees of both tables; only rows of ranges that differ are read again and compared. Tables without a key
    have the verdict MATCH where they hold the same rows as often, by their fingerprints, else NO_PK.
    """
    spark, kinds = source.sparkSession, ("SOURCE_ONLY", "TARGET_ONLY", "CONTENT_DIFF")
    row = lambda counts, said: F.struct(F.lit(name).alias("table_name"), *[F.lit(c).cast("bigint").alias(k.lower()) for k, c in zip(kinds, counts, strict=True)], F.lit(said).alias("verdict"))
    if not pk:
        prints = [tuple(fingerprint(df, source.columns).first()) for df in (source, target)]
        return spark.range(1).select(F.inline(F.array(row((0, 0, 0), "MATCH" if prints[0] == prints[1] else "NO_PK"))))
    found = digest_tree.unequal(source, target, source.columns, pk, fan, levels)
    if not found.levels[0][1]:
        return spark.range(1).select(F.inline(F.array(row((0, 0, 0), "MATCH"))))
    counts = [F.count_if(F.col("diff_type") == k).alias(k.lower()) for k in kinds]
    verdict = F.when(F.col("source_only") + F.col("target_only") + F.col("content_diff") == 0, "MATCH").otherwise("MISMATCH")
    return row_diff(found.source, found.target, pk).agg(*counts).select(F.lit(name).alias("table_name"), *[k.lower() for k in kinds], verdict.alias("verdict"))


def capped(diff: DataFrame, pk: list[str], most: int = 100) -> DataFrame:
    """The first ``most`` differences in key order, for a report."""
    return diff.orderBy(*pk).limit(most)


def count_difference(pairs: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """source_count, target_count and their difference for each named pair."""
    out = None
    for name, a, b in pairs:
        x = a.agg(F.count("*").alias("source_count")).withColumn("side", F.lit(name))
        y = b.agg(F.count("*").alias("target_count")).withColumn("side", F.lit(name))
        one = x.join(y, "side").select(F.col("side").alias("table_name"), "source_count", "target_count", F.abs(F.col("source_count") - F.col("target_count")).alias("difference"))
        out = one if out is None else out.union(one)
    return out


def row_diff(source: DataFrame, target: DataFrame, pk: list[str]) -> DataFrame:
    """pk, diff_type and fields of rows that differ: one full outer join, no paging, no missed rows."""
    rest = [c for c in source.columns if c not in pk]
    kinds_s, kinds_t = dict(source.dtypes), dict(target.dtypes)
    s = source.select(*pk, F.struct(*[text_of(c, kinds_s[c]).alias(c) for c in rest]).alias("s"))
    t = target.select(*pk, F.struct(*[text_of(c, kinds_t[c]).alias(c) for c in rest]).alias("t"))
    x = s.join(t, pk, "full_outer")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")), F.lit(c)) for c in rest]))
    kind = F.when(F.col("t").isNull(), "SOURCE_ONLY").when(F.col("s").isNull(), "TARGET_ONLY").when(F.size(fields) > 0, "CONTENT_DIFF")
    x = x.select(*pk, kind.alias("diff_type"), F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), F.array_join(fields, ",")).otherwise(F.lit("")).alias("fields"))
    return x.where("diff_type IS NOT NULL")


def repair_actions(diff: DataFrame) -> DataFrame:
    return diff.withColumn("action", F.when(F.col("diff_type") == "TARGET_ONLY", F.lit("DELETE")).otherwise(F.lit("UPSERT")))


def repaired(source: DataFrame, target: DataFrame, diff: DataFrame, pk: list[str]) -> DataFrame:
    """The target after its repair."""
    put = source.join(diff.where("diff_type <> 'TARGET_ONLY'"), pk, "left_semi")
    return target.join(diff, pk, "left_anti").unionByName(put)


def document_diff(source: DataFrame, target: DataFrame, key: str, doc: str) -> DataFrame:
    """Documents that differ, with the keys that do; ``doc`` is a map of text, compared key by key over both."""
    x = source.select(key, F.col(doc).alias("s")).join(target.select(key, F.col(doc).alias("t")), key, "full_outer")
    uneven = F.map_filter(F.map_zip_with("s", "t", lambda k, a, b: ~a.eqNullSafe(b)), lambda k, v: v)
    kind = F.when(F.col("t").isNull(), "SOURCE_ONLY").when(F.col("s").isNull(), "TARGET_ONLY").when(F.size(uneven) > 0, "CONTENT_DIFF")
    return x.select(key, kind.alias("diff_type"), F.coalesce(F.array_join(F.array_sort(F.map_keys(uneven)), ","), F.lit("")).alias("fields")).where("diff_type IS NOT NULL")
