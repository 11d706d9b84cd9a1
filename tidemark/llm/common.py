"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte values that separate words: space and \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; where its scan has fewer tasks than the session has cores (one small file), its rows are dealt over them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none and runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table, for rows of much text."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/saved_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns never clash with an operator's own."""
    return docs.select(*[docs[c] for c in columns])


def slices(batches, rows: int = 512):
    """Record batches cut into pieces that bound what Python holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized_slices(batches, column: str, most_bytes: int = 4 << 20, rows: int = 1024):
    """Like ``slices``, but a piece ends also where its ``column`` exceeds ``most_bytes``."""
    for piece in slices(batches, rows):
        sizes = pc.fill_null(pc.binary_length(piece.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield piece.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield piece.slice(start)


def release() -> None:
    """Give memory that Arrow holds in this worker back to the system."""
    pa.default_memory_pool().release_unused()


def word_split(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as an array; null or blank: empty array."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """doc_id, text and label of at most ``bound`` labelled ids outside the held-out fold, chosen by a hash of the doc_id.

    Labels that are neither 0 nor 1 don't count. The chosen ids are ``bound`` at most, and so can be broadcast. Where
    documents repeat an id, each row of it is here: a model takes one of them (see its fit).
    """
    known = labels.where(labels["doc_id"].isNotNull() & labels[label].isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.where(crc_fold(F.col("doc_id"), folds) != held_out)
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(bound)), "doc_id").limit(bound)
    return only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
