"""A corpus pipeline of five stages over ``documents``; see README.md.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder
and reads it again. All stages but the last return the columns of documents. Decisions name rows by ids of their own
(``identified``), so rows without a doc_id and different rows that share one are decided each by itself.

Results for odd input: no rows in, no rows out, from every stage; columns beyond those of documents don't count and are
not kept; rows without a doc_id keep none. Null and empty texts are scored like any other, are one text to exact dedup,
are alike to none in near dedup, and the mix takes nothing of them or of blank ones; in tokens alone they have no ids.
Repeated rows of one document become one in exact dedup. Texts of any length go through whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, chunk_dedup, minhash_dedup, quality_gam, source_mix
from tidemark.llm.common import ensure_checkpoint_dir, saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with an id for each different row in doc_id and the one it came with in own_id.

    A doc_id that names one row, however often repeated, stays; else the id is a hash of the row, so that every stage
    and every run finds the same.
    """
    docs = docs.select(*COLUMNS)
    row = F.xxhash64(*[F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n")) for c in COLUMNS]).bitwiseAND(F.lit((1 << 63) - 1))
    shared = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    # As a table, whose size is known: it is small or empty, and then the texts aren't shuffled to meet it.
    shared = saved(shared.where("low <> high").select("doc_id", F.lit(True).alias("_shared")))
    x = docs.join(shared, "doc_id", "left").withColumn("own_id", F.col("doc_id"))
    return x.withColumn("doc_id", F.when(F.col("own_id").isNotNull() & F.col("_shared").isNull(), F.col("own_id")).otherwise(row)).select(*COLUMNS, "own_id")


def restored(docs: DataFrame) -> DataFrame:
    """Rows of ``identified`` in the columns of documents, with the ids they came with."""
    return docs.withColumn("doc_id", F.col("own_id")).select(*COLUMNS)


def kept(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``decisions``."""
    return docs.join(decisions.select("doc_id").distinct(), "doc_id", "left_semi")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score 0.3 or more)."""
    docs = identified(docs)
    labels = table(spark, sf_dir, "labels")
    # A label of a shared doc_id is one of each row that shares it.
    shared = docs.where("own_id IS NOT NULL AND doc_id <> own_id").select("own_id", F.col("doc_id").alias("_id")).distinct()
    labels = labels.join(shared, labels["doc_id"] == shared["own_id"], "left").withColumn("doc_id", F.coalesce("_id", "doc_id")).select(*labels.columns)
    scored = quality_gam.quality(docs, labels)
    return restored(kept(docs, scored.where("predicted = 1")))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of repeated rows of one document one."""
    docs = identified(docs)
    return restored(kept(docs, chunk_dedup.chunk_dedup(docs).where("kept")).dropDuplicates(["doc_id"]))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    docs = identified(docs)
    return restored(kept(docs, minhash_dedup.near_dedup(docs).where("kept")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or several times."""
    docs = identified(docs)
    copies = source_mix.mix_sources(docs).where("copies > 0").select("doc_id", "copies")
    return restored(docs.join(copies, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each document, for each time the mix takes it."""
    import public_tokenizers

    return byte_bpe.encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", good_quality), ("exact_dedup", no_copies), ("near_dedup", no_near_copies), ("mix", mixed), ("tokens", tokens)]

#: The classifier and the tokenizer have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline_{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
