"""Exact dedup by content-defined chunk recipes.

A text (A-Z lower-cased, null as empty) is cut where a rolling hash of its last 16 bytes has its low bits
zero. A chunk is known by a 64-bit hash; an independent digest verifies that chunks of one hash have the same
bytes, and a hash that stands for several contents gets a variant number for each. A document's recipe is the
ordered list of its verified identifiers, eight bytes a kilobyte of text, and documents are equal when their
recipes are. Texts never leave the task that reads them.

Results for odd input: no rows in, no rows out; null and empty texts equal one another; texts of any length are
cut alike; repeated rows (equal doc_id too) form one group of which one row is kept; a null doc_id ranks below all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, only, sized_slices, table

ROLL = np.random.default_rng(6).integers(1, 2**32, 256, dtype=np.uint32) | np.uint32(1)
MULT = 0x9E3779B1


def cut_points(data: bytes, mean: int = 1024, least: int = 256, most: int = 8192) -> list[int]:
    """Ends of the chunks of ``data``; they depend on nearby bytes only."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = ROLL[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] * np.uint32(pow(MULT, step, 2**32))
    ends, last = [], 0
    for at in (np.flatnonzero((h >> np.uint32(9)) % np.uint32(mean) == 0) + 1).tolist():
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def recipe_rows(batches):
    for piece in sized_slices(batches, "text"):
        out = {"doc_id": piece.column("doc_id"), "text_sha256": [], "chunks": []}
        for text in piece.column("text").to_pylist():
            data = (text or "").encode().lower()
            out["text_sha256"].append(hashlib.sha256(data).hexdigest())
            chunks, start = [], 0
            for end in cut_points(data):
                chunk = data[start:end]
                digest = hashlib.sha256(chunk).digest()
                chunks.append({"id": xxhash.xxh3_64_intdigest(chunk) - 2**63, "proof": int.from_bytes(digest[:8], "little", signed=True)})
                start = end
            out["chunks"].append(chunks)
        yield pa.RecordBatch.from_arrays(
            [out["doc_id"].cast(pa.int64()), pa.array(out["text_sha256"], pa.string()), pa.array(out["chunks"], pa.list_(pa.struct([("id", pa.int64()), ("proof", pa.int64())])))],
            ["doc_id", "text_sha256", "chunks"],
        )


def chunk_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and n_chunks of every row of ``docs`` (doc_id, text)."""
    rows = only(docs, "doc_id", "text").mapInArrow(recipe_rows, "doc_id long, text_sha256 string, chunks array<struct<id: long, proof: long>>")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    pieces = rows.select("row", F.posexplode("chunks").alias("at", "chunk")).select("row", "at", "chunk.*")
    # Contents of one hash beyond the first: none, unless two chunks collide.
    several = pieces.groupBy("id").agg(F.min("proof").alias("low"), F.max("proof").alias("high")).where("low <> high").select("id")
    variants = (
        pieces.join(several, "id", "left_semi").select("id", "proof").distinct()
        .withColumn("variant", F.row_number().over(Window.partitionBy("id").orderBy("proof")))
    )
    named = pieces.join(variants, ["id", "proof"], "left").select("row", "at", "id", F.coalesce("variant", F.lit(1)).alias("variant"))
    recipes = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "id", "variant"))).alias("list"))
    recipes = recipes.select("row", F.transform("list", lambda x: F.struct(x["id"].alias("id"), x["variant"].alias("variant"))).alias("recipe"))
    whole = rows.select("row", "doc_id", "text_sha256", F.size("chunks").alias("n_chunks")).join(recipes, "row", "left")
    whole = cut(whole.withColumn("recipe", F.coalesce("recipe", F.array().cast("array<struct<id: bigint, variant: int>>"))))
    # Written, so that the join below deals both sides itself and can split the rows of a large group.
    best = cut(whole.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size")).where("group_size > 1"))
    out = whole.join(best, "recipe", "left")
    return out.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "n_chunks",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""
