"""Phrase collocations by hashed bucket counts (PCY, DHP) and Apriori pruning before exact counting.

Phrases are counted by length, one pass over the texts a length. While a pass counts its phrases exactly, it also counts the
phrases one word longer by hash bucket. A bucket with fewer than ``least`` of them holds no frequent phrase; the others make
a bitmap of ``1 << BITS`` bits. The next pass counts exactly only the phrases whose bucket is in that bitmap and whose two
parts, without the last and without the first word, are in a bitmap of the frequent phrases of the pass before (Apriori);
and buckets are counted only where both of the longer phrase's parts passed these tests (DHP). The two bitmaps are all
that goes to the tasks: 8 MB each, whatever the input. Where buckets fill up, more phrases are counted; none is lost.

Tasks count in flushes of ``FLUSH`` words: a flush numbers its words, hashes every window of k words from 64-bit word
hashes seeded by the language, and groups equal windows by sorting these, comparing the words themselves, so that two
phrases never mix. What leaves a flush is one row a phrase and small tables of bucket counts, which stop at 255.

Results for odd input: no rows in, no rows out; null and empty texts have no words; null languages count as ``und``, together
with documents that say so; long texts count whole; repeated rows are occurrences like others; ties go by count and phrase.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, only, saved, sized_slices, table

LEAST, LONGEST, BEST = 100, 5, 2000
#: Buckets are 1 << BITS, in parts of 1 << PART of them.
BITS, PART = 26, 16
FLUSH = 1 << 21
#: Candidates of a language are ranked in so many groups first.
SALTS = 256
#: Bytes that end a piece become a full stop, those that end a word a space.
ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")
RAW = "lang string, phrase string, f long, h long, part int, payload binary"


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the window hashed ``h`` with ``word`` behind it."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hash(word: bytes, lang: str) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang.encode()))


def has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Numbers(dict):
    """Numbers of a language's words, given as they are met."""

    def __init__(self, lang: str, words: list[bytes], langs: list[str]):
        super().__init__({b".": -1})
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return n


class Block:
    """Words of some texts as numbers, -1 between pieces."""

    def __init__(self):
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.of_lang: dict[str, Numbers] = {}

    def numbers(self, lang: str) -> dict[bytes, int]:
        if lang not in self.of_lang:
            self.of_lang[lang] = Numbers(lang, self.words, self.langs)
        return self.of_lang[lang]

    def add(self, text: str, lang: str) -> None:
        tokens = text.encode().lower().translate(ENDS).replace(b".", b" . ").split()
        self.ids.append(np.array([*map(self.numbers(lang).__getitem__, tokens), -1], np.int64))
        self.size += len(tokens)

    def grouped(self, at: np.ndarray, h: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First places and numbers of the different windows of k words that begin at ``at`` and are hashed ``h``."""
        order = np.argsort(h, kind="stable")
        same_hash = h[order[1:]] == h[order[:-1]]
        equal = lambda p: np.logical_and.reduce([ids[p[1:] + j] == ids[p[:-1] + j] for j in range(k)])
        same = equal(at[order])
        if (same_hash & ~same).any():  # different windows of one hash: sort by the words as well
            order = np.lexsort([*[ids[at + j] for j in range(k)], h])
            same = equal(at[order])
        first = np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
        return at[order[first]], np.diff(np.append(first, len(order)))

    def counts(self, k: int, frequent: np.ndarray | None, buckets: np.ndarray | None, longest: int):
        """Record batches of phrases of k words with their counts, and of bucket counts of phrases one word longer."""
        ids = np.concatenate(self.ids)
        word = np.array([word_hash(w, x) for w, x in zip(self.words, self.langs, strict=True)] + [0], np.uint64)[ids]
        if k == 1:
            at = np.flatnonzero(ids >= 0)
            h = word[at]
        else:
            h = word
            for j in range(1, k - 1):
                h = mixed(h[:-1], word[j:])
            whole = np.ones(len(h), bool)
            for j in range(k - 1):
                whole &= ids[j : j + len(h)] >= 0
            parts = np.zeros(len(h), bool)
            parts[whole] = has(frequent, h[whole])
            at = np.flatnonzero(parts[:-1] & parts[1:])
            h = mixed(h[at], word[at + k - 1])
            kept = has(buckets, h)
            at, h = at[kept], h[kept]
        if len(at):
            first, n = self.grouped(at, h, ids, k)
            hash_of = np.zeros(len(ids), np.uint64)
            hash_of[at] = h
            words = self.words
            said = [b" ".join([words[i] for i in row]).decode() for row in ids[first[:, None] + np.arange(k)].tolist()]
            lang = [self.langs[i] for i in ids[first].tolist()]
            yield batch(lang=lang, phrase=said, f=n, h=hash_of[first].view(np.int64))
            if k < longest:
                next_ = np.flatnonzero(np.diff(at) == 1)
                longer = mixed(h[next_], word[at[next_] + k])
                yield from bucket_rows(longer >> np.uint64(64 - BITS), None)


def batch(**columns) -> pa.RecordBatch:
    """Rows of the raw counts, null where no column is given."""
    n = len(next(iter(columns.values())))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64()), ("h", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def bucket_rows(buckets: np.ndarray, count: int | None):
    """One row a part of the buckets met: places within the part, 2 bytes each, then counts up to 255, or ``count``, a byte each."""
    at, n = np.unique(buckets.astype(np.uint32), return_counts=True)
    if not len(at):
        return
    n = np.minimum(n if count is None else count, 255) * np.ones(len(at), np.int64)
    part = at >> np.uint32(PART)
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    low, n = (at & np.uint32((1 << PART) - 1)).astype("<u2"), n.astype(np.uint8)
    payload = [low[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(at)), strict=True)]
    yield batch(part=part[cut], payload=payload)


def counted(docs: DataFrame, k: int, frequent, buckets, longest: int) -> DataFrame:
    """Raw rows of a pass over ``docs`` (text, lang); ``frequent`` and ``buckets`` are broadcast bitmaps, None in the first pass."""

    def rows(batches):
        maps = [np.frombuffer(b.value, np.uint8) if b is not None else None for b in (frequent, buckets)]
        block = Block()
        for piece in sized_slices(batches, "text"):
            for text, lang in zip(piece.column("text").to_pylist(), piece.column("lang").to_pylist(), strict=True):
                if text:
                    block.add(text, "und" if lang is None else lang)
                if block.size >= FLUSH:
                    yield from block.counts(k, *maps, longest)
                    block = Block()
        if block.ids:
            yield from block.counts(k, *maps, longest)

    return docs.mapInArrow(rows, RAW)


def bitmap(parts: DataFrame, least: int):
    """Broadcast bitmap of the buckets whose counts in ``parts`` (part, payload) reach ``least``, 255 at most."""

    def fold(batches):
        now, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], ["part", "bits"])
        for b in batches:
            for part, payload in zip(b.column("part").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield out()
                    now, total = part, np.zeros(1 << PART, np.int64)
                n = len(payload) // 3
                total[np.frombuffer(payload, "<u2", n)] += np.frombuffer(payload, np.uint8, n, 2 * n)
        if now is not None:
            yield out()

    found = parts.repartition("part").sortWithinPartitions("part").mapInArrow(fold, "part int, bits binary")
    whole, size = bytearray(1 << (BITS - 3)), 1 << (PART - 3)
    for row in found.toLocalIterator():  # at most 1 << (BITS - PART) rows of 8 KB
        whole[row.part * size : (row.part + 1) * size] = row.bits
    return parts.sparkSession.sparkContext.broadcast(bytes(whole))


def hashes(frequent: DataFrame) -> DataFrame:
    """(part, payload) of the hashes of frequent phrases."""

    def rows(batches):
        for b in batches:
            yield from (x.select(["part", "payload"]) for x in bucket_rows(b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - BITS), 255))

    return frequent.select("h").mapInArrow(rows, "part int, payload binary")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to ``longest`` words found ``least`` times or more, and (lang, n) of all words."""
    if not 1 <= least <= 255:
        raise ValueError("bucket counts stop at 255, so phrases must be asked for by 1 to 255 occurrences")
    docs = only(docs, "text", "lang")
    found, total, maps = [], None, (None, None)
    for k in range(1, longest + 1):
        raw = saved(counted(docs, k, *maps, longest))
        counts = raw.where("phrase IS NOT NULL")
        if k == 1:
            total = saved(counts.groupBy("lang").agg(F.sum("f").alias("n")))
        frequent = saved(counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.max("h").alias("h")).where(F.col("f") >= least))
        found.append(frequent.select("lang", "phrase", F.lit(k).alias("k"), "f"))
        if k < longest:
            old, maps = maps, (bitmap(hashes(frequent), 1), bitmap(raw.where("part IS NOT NULL").select("part", "payload"), least))
            for b in old:
                if b is not None:
                    b.unpersist()
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every, total


def big(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def scored(frequent: DataFrame, total: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n and score of every phrase of two words or more, by its lowest cut, of equal ones the first."""
    words = F.split("phrase", " ")
    part = lambda begin, n: F.array_join(F.slice(words, begin, n), " ")
    cuts = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    x = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(total, "lang")
    x = x.withColumns({"up": F.lit(1000).cast("decimal(38,0)") * big("a") * big("n"), "down": big("l") * big("r")}).withColumn("score", F.expr("up div down"))
    best = x.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "k", "a", "n")).alias("b"))
    return best.select("lang", "phrase", "b.k", "b.a", "b.l", "b.r", "b.n", "b.score")


def not_covered(candidates: DataFrame) -> DataFrame:
    """Without phrases that stand in a longer one found as often.

    A phrase between the two is found as often too, so that looking one word further suffices.
    """
    words = F.split("phrase", " ")
    inner = F.explode(F.array(*[F.array_join(F.slice(words, F.lit(b), F.col("k") - 1), " ") for b in (1, 2)]))
    covered = candidates.where("k > 2").select("lang", "a", inner.alias("phrase")).distinct()
    return candidates.join(covered, ["lang", "phrase", "a"], "left_anti")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST) -> DataFrame:
    """The ``best`` phrases of each language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n and score."""
    ensure_checkpoint_dir(docs.sparkSession)
    frequent, total = frequent_phrases(docs, least, longest)
    candidates = not_covered(saved(scored(frequent, total)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The best of each salt first, so that no task sorts a whole language.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
t AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, a, cut, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score FROM c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(words[1 : cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(words[cut + 1 : c.k], ' ') JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.k > b.k AND 100 * f.f >= 100 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o QUALIFY rank <= 2000
"""
