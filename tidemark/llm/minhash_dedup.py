"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on full shingle sets.

Every text becomes a set of word shingles. Equal sets form a class, of which one member goes on. ``BANDS`` x ``ROWS``
MinHash values give each class its band buckets, and are folded into an odd sketch: a bitmap in which each sample
flips one bit, so that the XOR of two bitmaps counts the samples in which the sets differ. At the least similarity
of 0.8 two sets share no band with a probability of 5e-8.

1. In each bucket every class is tried against the one that meets most others (its pivot): a star, not all pairs.
2. Pairs whose sketches' XOR population counts allow the similarity are confirmed on the full sets. A second bitmap,
   of the whole set instead of its samples, sharpens the test for sets of up to a few thousand.
3. Those whose component isn't their pivot's are tried against a few more members of each bucket likewise.
4. Classes of one bucket that are still in different components are tried against each other, the sketch test
   standing inside the join's condition, so that only promising pairs leave it; they are confirmed likewise. A large
   bucket is dealt in blocks: each block of those left meets each block of the bucket in a group of its own, so that no
   task has more than ``BLOCK`` x ``BLOCK`` of them to compare.

Confirming sends a hub's text (the pivot's) once for every ``STAR`` of its pairs, ahead of them, and its set is held while
they stream past. No link between different sets is lost but by the probabilities named. Nothing is collected.

Results for odd input: no rows in, no rows out; null, empty and blank texts have an empty set and link with nothing;
texts with fewer words than a shingle have one shingle; repeated rows are in one class, each of them kept where its
doc_id is the component's smallest; rows with a null doc_id get a null component_id and are not kept.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, only, release, saved, sized_slices, table
from ..operators.components import components

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 16  # of 64 bits
SKETCH_BITS = 64 * SKETCH_WORDS
DRAWN = 3
BLOCK = 1024
STAR = 256

_random = np.random.default_rng(2)
MULTIPLY = _random.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 2**63, SAMPLES, dtype=np.uint64)
POSITION = _random.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``words`` words, A-Z lower-cased."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, found), np.uint64, len(found))
    if len(h) < words:
        return mix(np.array([int(x) * (2 * i + 3) % 2**64 for i, x in enumerate(h)], np.uint64)).sum(dtype=np.uint64, keepdims=True)
    n = len(h) - words + 1
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total += mix(h[i : i + n] * POSITION[i % 16] + np.uint64(i))
    return np.unique(mix(total))


def minhash(values: np.ndarray) -> np.ndarray:
    best = np.full(SAMPLES, ~np.uint64(0))
    for at in range(0, len(values), 2048):
        some = MULTIPLY[:, None] * values[None, at : at + 2048]
        some += ADD[:, None]
        np.minimum(best, some.min(1), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bits that an odd number of the (index, sample) pairs falls on, as ``SKETCH_WORDS`` words."""
    bit = (mix(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def most_differing_bits(similarity: float) -> int:
    """XOR population count that sets of this similarity exceed once in some 1e5 pairs."""
    least = similarity - 4.5 * math.sqrt(similarity * (1 - similarity) / SAMPLES)
    differ = 2 * SAMPLES * (1 - max(0.0, least))
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * differ / SKETCH_BITS)))


def parity(values: np.ndarray) -> np.ndarray:
    """The odd sketch of a whole set: sets of a few thousand differ in it by about what they differ."""
    odd = (np.bincount((mix(values) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set), bands, sketch and parity of each row."""

    def rows(batches):
        none = [0] * SKETCH_WORDS
        for piece in sized_slices(batches, "text"):
            out = []
            for text in piece.column("text").to_pylist():
                s = shingles(text, words)
                if not len(s):
                    out.append((0, None, [], none, none))
                    continue
                m = minhash(s)
                of = mix(m.reshape(BANDS, ROWS) * POSITION[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
                out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), mix(of).view(np.int64).tolist(), odd_sketch(m).tolist(), parity(s).tolist()))
            longs = pa.list_(pa.int64())
            arrays = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), longs, longs, longs), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), *arrays], ["doc_id", "n_shingles", "set_key", "bands", "sketch", "parity"])
        release()

    return only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>, parity array<long>")


def differing(column: str, a: str, b: str) -> Column:
    """XOR population count of a bitmap column of two rows."""
    return sum((F.bit_count(F.col(f"{a}.{column}")[i].bitwiseXOR(F.col(f"{b}.{column}")[i])) for i in range(SKETCH_WORDS)), F.lit(0))


def promising(a: str, b: str, percent: int) -> Column:
    """Whether the sketches of two rows allow the similarity; false for a pair that has it once in some 1e5 pairs."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    # The most that sets of these sizes may differ; no more bits can. As bits that are hit twice cancel, fewer do:
    # five deviations above their mean, by the exact variance for that many items thrown into the bitmap.
    apart = (x + y) * ((100 - percent) / (100 + percent))
    odd = SKETCH_BITS / 2 * (1 - F.exp(-2 * apart / SKETCH_BITS))
    spread = F.greatest(F.lit(1.0), SKETCH_BITS / 4 * (1 - F.exp(-4 * apart / SKETCH_BITS)) - apart * F.exp(-4 * apart / SKETCH_BITS))
    most = F.least(apart + 1e-6, odd + 5 * F.sqrt(spread))
    sizes = 100 * F.least(x, y) >= percent * F.greatest(x, y)
    return sizes & (differing("sketch", a, b) <= most_differing_bits(percent / 100)) & (differing("parity", a, b) <= most)


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (leaf, hub) of doc_ids those whose full sets, from ``texts`` (doc_id, text), are similar enough, as (a, b)."""

    def rows(batches):
        now, held = None, np.zeros(0, np.uint64)
        for piece in sized_slices(batches, "text"):
            good = []
            for hub, leaf, text in zip(*(piece.column(c).to_pylist() for c in ("hub", "leaf", "text")), strict=True):
                if leaf is None:
                    now, held = hub, shingles(text, words)
                    continue
                assert hub == now  # each share of a hub's pairs begins with its text
                x = shingles(text, words)
                both = len(np.intersect1d(x, held, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(held) - both):
                    good.append((max(leaf, hub), min(leaf, hub)))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], ["a", "b"])
        release()

    shares = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).alias("shares"))
    dealt = pairs.join(shares, "hub").select("leaf", "hub", F.pmod(F.xxhash64("leaf", "hub"), "shares").alias("share"))
    leaves = dealt.join(texts, dealt["leaf"] == texts["doc_id"]).select("hub", "share", "leaf", "text")
    hubs = dealt.select("hub", "share").distinct().join(texts, F.col("hub") == texts["doc_id"]).select("hub", "share", F.lit(None).cast("long").alias("leaf"), "text")
    both = leaves.union(hubs).repartition("hub", "share").sortWithinPartitions("hub", "share", F.col("leaf").asc_nulls_first())
    return both.mapInArrow(rows, "a long, b long")


def toward(pairs: DataFrame, leaf: str, hub: str) -> DataFrame:
    """Distinct pairs, in whatever order, as (leaf, hub)."""
    one = pairs.select(F.greatest(leaf, hub).alias("_a"), F.least(leaf, hub).alias("_b"), F.col(hub).alias("hub")).groupBy("_a", "_b").agg(F.max("hub").alias("hub"))
    return one.select(F.when(F.col("hub") == F.col("_a"), F.col("_b")).otherwise(F.col("_a")).alias("leaf"), "hub")


def blocks_that_meet(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of ``left`` (bucket, class, root, apart) in groups (bucket, i, j): block i of those apart and block j of all."""
    sizes = left.groupBy("bucket").agg(F.ceil(F.count_if("apart") / BLOCK).cast("long").alias("ni"), F.ceil(F.count("*") / BLOCK).cast("long").alias("nj"))
    x = left.join(sizes, "bucket")
    own = lambda n: F.pmod(F.xxhash64("class", "bucket"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    return (
        x.where("apart").select("bucket", "class", "root", "apart", own("ni").alias("i"), every("nj").alias("j")),
        x.where("ni > 0").select("bucket", "class", "root", "apart", every("ni").alias("i"), own("nj").alias("j")),
    )


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text)."""
    signed = cut(signatures(docs, words))
    sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = sets.groupBy("set_key").agg(F.min("doc_id").alias("class"), F.count("*").alias("n"))
    chosen = classes.select(F.col("class").alias("doc_id"))
    # Read for the buckets' sizes, their members and the sketches.
    one = cut(sets.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("class"), "n_shingles", "bands", "sketch", "parity"))

    members = one.select("class", F.explode("bands").alias("bucket"))
    members = members.join(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")
    # The pivot of a bucket is its most sociable member: in a group of copies the one nearest to all, not an outlier.
    met = members.groupBy("class").agg(F.sum("n").alias("met"))
    members = cut(members.join(met, "class").select("bucket", "class", "met"))
    pivots = members.groupBy("bucket").agg(F.max(F.struct("met", F.xxhash64("class").alias("at"), "class"))["class"].alias("pivot"))
    members = cut(members.join(pivots, "bucket").select("bucket", "class", "pivot"))
    busy = members.select("class").distinct()
    sketches = cut(one.join(busy, "class", "left_semi").select("class", "n_shingles", "bands", "sketch", "parity"))
    texts = only(docs, "doc_id", "text").join(busy.select(F.col("class").alias("doc_id")), "doc_id", "left_semi")
    texts = saved(texts.dropDuplicates(["doc_id"]))  # a doc_id may stand in repeated rows

    star = toward(members.where("class <> pivot"), "class", "pivot")
    of = lambda side: F.struct("n_shingles", "sketch", "parity").alias(side)

    def sketched(pairs: DataFrame) -> DataFrame:
        x = pairs.join(sketches.select(F.col("class").alias("leaf"), of("x")), "leaf").join(sketches.select(F.col("class").alias("hub"), of("y")), "hub")
        return x.where(promising("x", "y", percent)).select("leaf", "hub")

    links = cut(confirm(sketched(star), texts, words, percent))
    roots = components(links)

    # Members whose component isn't their pivot's, and all members of their buckets.
    placed = (
        members.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        .join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root")), "pivot", "left").withColumn("pivot_root", F.coalesce("pivot_root", "pivot"))
    )
    placed = cut(placed.where("class <> pivot").select("bucket", "class", "root", "pivot_root"))
    # They are tried against a few more members, drawn anew for each bucket: most that link to anyone link to one of them.
    draw = [F.min(F.struct(F.xxhash64("class", "bucket", F.lit(i)).alias("at"), "class", "root")) for i in range(DRAWN)]
    drawn = placed.groupBy("bucket").agg(F.array(*draw).alias("drawn"))
    tried = placed.where("root <> pivot_root").join(drawn, "bucket").select("class", "root", F.explode("drawn").alias("d")).where("root <> d.root")
    tried = cut(tried.select("class", F.col("d.root").alias("to_root"), F.col("d.class").alias("drawn"), F.greatest("class", "d.class").alias("a"), F.least("class", "d.class").alias("b")).distinct())
    second = cut(confirm(sketched(toward(tried, "class", "drawn")), texts, words, percent))
    moved = tried.join(second, ["a", "b"]).groupBy("class").agg(F.min("to_root").alias("to_root"))
    placed = placed.join(moved, "class", "left").withColumn("root", F.coalesce("to_root", "root"))
    # Read three times below.
    placed = cut(placed.select("bucket", "class", "root", (F.col("root") != F.col("pivot_root")).alias("apart")))
    apart = placed.where("apart")
    # The pivot has been tried against all; of a bucket without two others, or all of one component, nothing is left.
    more = apart.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    others = placed.where("NOT apart").select("bucket").distinct().withColumn("some", F.lit(True))
    more = more.join(others, "bucket", "left").where("some OR low <> high").select("bucket")
    left = cut(placed.join(more, "bucket", "left_semi"))
    x, y = (side.join(sketches, "class").alias(name) for side, name in zip(blocks_that_meet(left), "xy", strict=True))
    # Of two members that stand apart the larger is x; the rest are y. A pair counts in the first bucket that it shares.
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket")
    met = reduce(Column.__and__, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bucket", "i", "j")])
    rest = x.join(y, met & (F.col("x.root") != F.col("y.root")) & ((F.col("x.class") > F.col("y.class")) | ~F.col("y.apart")) & promising("x", "y", percent) & once)
    rest = toward(rest.select(F.col("x.class").alias("p"), F.col("y.class").alias("q")), "p", "q")
    found = cut(confirm(rest, texts, words, percent))
    found = found.union(second)
    if not found.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))

    known = (
        classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
        .where("n > 1 OR root IS NOT NULL").select("set_key", F.coalesce("root", "class").alias("root"))
    )
    out = signed.select("doc_id", "n_shingles", "set_key").join(known, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=2)


#: Pairs that share a shingle and are similar enough, then the smallest doc_id that each document reaches.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]]
        ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
seen AS (SELECT shingle, count(*) AS df FROM s GROUP BY shingle),
ranked AS (SELECT doc_id, s.shingle, row_number() OVER (PARTITION BY doc_id ORDER BY df, s.shingle) AS pos FROM s JOIN seen USING (shingle)),
head AS (SELECT doc_id, shingle FROM ranked JOIN n USING (doc_id) WHERE pos <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM head x JOIN head y ON x.shingle = y.shingle AND x.doc_id < y.doc_id),
sized AS (SELECT a, b, x.n AS na, y.n AS nb FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
links AS (SELECT a, b FROM sized p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.shingle = x.shingle GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
bothways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, bothways.b FROM reach JOIN bothways ON reach.r = bothways.a),
least_ AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_ LEFT JOIN n USING (doc_id)
"""
