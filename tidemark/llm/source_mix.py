"""Mixing sources to target weights by systematic sampling.

Targets are shares of all words by weight, none above ``most`` times its source's words: the excess goes to the others
by weight until none is above. Each round of that is one aggregate over the sources; three numbers come to the driver.
Within a source every document expects target / source words copies. Documents are put in order of size, their expected
copies are summed along that order from one random offset, and a document is emitted once for every whole number that
its step crosses: so any stretch of the order, and with it every range of sizes, gets its due within one copy.

The order is by (size class, salt, size, doc_id); the salt is the first byte of the doc_id's md5, so that a source of
any number of documents, even of equal sizes, is ranked in many tasks. Counts of (source, class, salt) give each
group's place. Sources are numbered in ranges of their names, so that they don't stand in one task either. The offset
is a hash of the source's name: reruns agree, at any size.

Results for odd input: no rows in, no rows out; null, empty and blank texts have size 0, no place in the order, and take
nothing; a source without words has target 0; long texts count whole; repeated rows are rows like any other; rows with a
null doc_id are salted by their text and come first among those of one size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, only, table, word_split


def key(source: Column) -> Column:
    """The source, told apart from null, as a name that isn't null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def numbered(sources: DataFrame) -> DataFrame:
    """Adds at: the place of each source by code point, null last, from 0."""
    order = F.col("source").asc_nulls_last()
    x = sources.repartitionByRange(order).sortWithinPartitions(order)
    # The row's number within its partition is in the low bits; checkpointed, as partitions are drawn by sampling.
    x = cut(x.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    parts = x.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return x.join(parts, "part").withColumn("at", F.col("ahead") + F.col("nth")).drop("part", "nth", "ahead")


def targets(sources: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """Adds target to ``sources`` (source, source_size); weights go round by code point, null last."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    x = numbered(sources).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    x = x.select("source", "source_size", "weight", "cap")
    total = float(x.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        # Whoever is capped stays so, as the level only rises.
        over = F.col("cap") <= F.col("weight") * level if capped >= 0 else F.lit(False)
        n, caps, rest = x.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not rest:
            break
        level, capped = (total - caps) / rest, n
    return x.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row of ``docs`` (doc_id, text, source)."""
    salt = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))), 1, 2)
    sized = only(docs, "doc_id", "text", "source").select("doc_id", "source", F.size(word_split(F.col("text"))).cast("long").alias("size"), salt.alias("salt"))
    sized = cut(sized.withColumn("class", F.floor(12 * F.log1p(F.col("size").cast("double"))).cast("long")))
    groups = sized.groupBy("source", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    goals = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    before = F.sum("n").over(Window.partitionBy("source").orderBy(F.col("class").desc(), "salt").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("before", F.coalesce(before, F.lit(0))).drop("n", "words")
    same = F.col("g.source").eqNullSafe(F.col("t.source"))
    groups = groups.alias("g").join(goals.alias("t"), same).select("g.*", "t.source_size", "t.target")
    at = F.row_number().over(Window.partitionBy("source", "class", "salt").orderBy(F.col("size").desc(), "doc_id"))
    ranked = sized.withColumn("within", at)
    on = F.col("r.source").eqNullSafe(F.col("g.source")) & (F.col("r.class") == F.col("g.class")) & (F.col("r.salt") == F.col("g.salt"))
    x = ranked.alias("r").join(groups.alias("g"), on).select("r.doc_id", "r.source", "r.size", "r.within", "g.before", "g.source_size", "g.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = (F.conv(F.substring(F.md5(key(F.col("source"))), 1, 5), 16, 10).cast("long") + 0.5) / 1048576
    x = x.withColumn("rate", rate).withColumn("offset", offset).withColumn("place", F.col("before") + F.col("within"))
    copies = F.floor(F.col("rate") * F.col("place") + F.col("offset")) - F.floor(F.col("rate") * (F.col("place") - 1) + F.col("offset"))
    # Blank documents come last in the order, so that leaving them out moves no other.
    return x.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


SQL = r"""
WITH d AS (SELECT doc_id, source, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
c AS (SELECT *, floor(12 * ln(1 + size::DOUBLE))::BIGINT AS class, substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 2) AS salt FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM c GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM s),
v AS (SELECT *, (pos % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM w),
u AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(source_size) OVER ()::DOUBLE AS total FROM v),
k AS (SELECT *, cap * rest <= weight * (total - caps) AS capped FROM u),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * (SELECT arg_min((total - caps) / rest, caps) FROM k WHERE NOT capped) END AS target FROM k),
r AS (SELECT c.*, source_size, target, row_number() OVER (PARTITION BY c.source ORDER BY class DESC, salt, size DESC, doc_id) AS place,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        (('0x' || substr(md5(coalesce('s' || c.source, 'n')), 1, 5))::BIGINT + 0.5) / 1048576 AS o
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN floor(rate * place + o) - floor(rate * (place - 1) + o) ELSE 0 END::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM e
"""
