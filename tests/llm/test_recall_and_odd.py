"""Recall of near-duplicate links, chunk hashes that collide, terms without a cap, and the pipeline on odd tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunk_dedup, minhash_dedup, suffix_dedup, toxicity
from tidemark.llm.common import table


def jaccard(a, b, words):
    x, y = set(minhash_dedup.shingles(a, words).tolist()), set(minhash_dedup.shingles(b, words).tolist())
    return len(x & y) / len(x | y)


def edited(r, text, words, low=0.80, high=0.85):
    """A version of the text whose sets of shingles have a similarity in that range, None where there is none."""
    now = text.split()
    for _ in range(len(now)):
        i = r.randrange(len(now))
        new = [*now[:i], f"new{r.randrange(10**6)}", *now[i + 1 :]]
        similar = jaccard(text, " ".join(new), words)
        if similar < low:
            continue
        now = new
        if similar <= high:
            return " ".join(now)
    return None


@pytest.mark.parametrize("words", [2, 5])
def test_links_of_least_similarity_are_found(spark, words):
    """Of pairs of real documents and edited versions of them, at 0.80 to 0.85: bands share a bucket and sketches let them pass."""
    r = random.Random(words)
    texts = [x.text for x in table(spark, "/root/testdata/sf0.01", "documents").where("n_chars BETWEEN 300 AND 6000").orderBy("doc_id").limit(400).collect()]
    pairs = [(t, e) for t in texts if (e := edited(r, t, words))]
    rows = [(2 * i + side, pair[side]) for i, pair in enumerate(pairs) for side in (0, 1)]
    signed = minhash_dedup.signatures(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), words)
    side = lambda odd, name: signed.where(F.col("doc_id") % 2 == odd).select(F.floor(F.col("doc_id") / 2).alias("i"), F.struct("n_shingles", "bands", "sketch", "parity").alias(name))
    both = side(0, "x").join(side(1, "y"), "i")
    n, banded, found = both.agg(F.count("*"), F.count_if(F.arrays_overlap("x.bands", "y.bands")), F.count_if(F.arrays_overlap("x.bands", "y.bands") & minhash_dedup.promising("x", "y", 80))).first()
    assert n == len(pairs) >= 250
    print(f"{words} words: {n} pairs, {banded} share a band, {found} found")
    assert found / n >= 0.999


@pytest.mark.parametrize("least", [31, 288, 1000])
def test_windows_beyond_a_bytes_reach_are_refused(spark, least):
    docs = spark.createDataFrame([(1, "x" * 2000)], "doc_id bigint, text string")
    for operator in (suffix_dedup.suffix_dedup, suffix_dedup.repeats):
        with pytest.raises(ValueError, match="windows have 32 to 287 bytes"):
            operator(docs, least)


@pytest.mark.parametrize("least", [32, 287])
def test_least_and_greatest_windows(spark, least):
    r = random.Random(least)
    shared = "".join(r.choice("abcdef ") for _ in range(400))
    docs = {i: "".join(r.choice("abcdefghij ") for _ in range(r.randint(0, 300))) + shared[r.randint(0, 90) :] for i in range(40)}
    seen, want = set(), {}
    for i, t in docs.items():
        mark = np.zeros(len(t), bool)
        for at in range(len(t) - least + 1):
            if t[at : at + least] in seen:
                mark[at : at + least] = True
            seen.add(t[at : at + least])
        want[i] = int(mark.sum())
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3), least)
    assert {x.doc_id: x.n_removed for x in got.collect()} == want and sum(want.values()) > 5000


def test_chunks_of_one_hash_are_told_apart(spark, monkeypatch):
    """Hashes of seven values: recipes still tell texts apart, as chunks are named by their proof too."""
    plain = chunk_dedup.recipe_rows

    def weak(batches):
        for batch in plain(batches):
            at = batch.schema.get_field_index("chunks")
            chunks = [[{"id": c["id"] % 7, "proof": c["proof"]} for c in row] for row in batch.column(at).to_pylist()]
            yield batch.set_column(at, "chunks", pa.array(chunks, batch.schema.field(at).type))

    monkeypatch.setattr(chunk_dedup, "recipe_rows", weak)
    r = random.Random(1)
    long = [" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(3000)) for _ in range(12)]
    texts = [*long, *long[:5], long[0].upper(), long[1] + "x", long[2][:-1], None, "", "a", "A", "b"]
    got = chunk_dedup.chunk_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    norm = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in texts]
    size, last = Counter(norm), {t: i for i, t in enumerate(norm)}
    assert {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got} == {i: (last[t], size[t], last[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}
    assert max(x.n_chunks for x in got) > 3


def test_long_words_are_terms(spark):
    """Words beyond twelve letters are learned whole, and every candidate counts: by one example, and by a naive choice."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeiou") + r.choice("bcdfg") for _ in range(3))
    clean = [" ".join(word() for _ in range(20)) for _ in range(150)]
    toxic = [" ".join([*(word() for _ in range(15)), "incomprehensibilities"]) for _ in range(60)]
    plain = [" ".join([*(word() for _ in range(15)), "incomprehensiblynice"]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(clean + toxic + plain)), "doc_id bigint, text string")
    labels = docs.select("doc_id", F.col("doc_id").between(150, 209).cast("int").alias("toxic"))
    lexicon = toxicity.fit_toxicity(docs, labels)
    assert set(lexicon.weights) == {"incomprehensibilities"} and lexicon.score(toxic[0]) > 0.5 > lexicon.score(plain[0])
    # The naive choice: all beginnings and words of the fitted texts, by the same counts.
    fitted = [(t, 150 <= i < 210) for i, t in enumerate(clean + toxic + plain) if __import__("zlib").crc32(str(i).encode()) % 4 != 2]
    n1, n0 = sum(x for _, x in fitted), sum(not x for _, x in fitted)
    count = Counter((term, x) for t, x in fitted for term in {w[:i] for w in t.split() for i in [*range(3, min(12, len(w)) + 1), len(w)]})
    naive = {t for t, x in count if x and count[t, True] >= max(4, round(0.006 * n1)) and np.log((count[t, True] + 0.5) / (n1 + 1)) - np.log((count[t, False] + 0.5) / (n0 + 1)) >= toxicity.LEAST_WEIGHT}
    assert set(lexicon.weights) <= naive
    assert len(toxicity.beginnings("x" * 100_000)) == 11


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_pipeline_on_odd_tables(spark):
    """Null and blank texts, null and shared ids, repeated rows, a very long text, extra columns; and no rows at all."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "  \n\t ", "en", None, 5), (4, long, "en", "b", len(long)), (None, "a text without an id " * 4, "en", "a", 1), (None, None, None, None, None)]
    rows += [(5, "one of two texts that share an id, of several words", "en", "a", 1), (5, "the other of two texts that share an id, as it is", "en", "b", 1), (6, "repeated rows of one document stay one", "en", "c", 1), (6, "repeated rows of one document stay one", "en", "c", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("own_id", "_shared", "copies", "row", "low", "high", "copy", "_id", "label", "ids", "predicted")])
    for make in (docs, clash):
        single = corpus_pipeline.no_copies(spark, make, sf_dir)
        kept = Counter(tuple(x) for x in single.collect())
        blank = [x for x in kept if not (x[1] or "")]
        # Null and empty texts are one text; every other text stays once.
        assert set(kept.values()) == {1} and len(blank) == 1 and {x[1] for x in kept} - {None, ""} == {x[1] for x in rows} - {None, ""}
        near = corpus_pipeline.no_near_copies(spark, make, sf_dir)
        assert {x.text for x in near.collect()} == {x[1] for x in rows}  # texts without shingles are alike to none
        mixed = corpus_pipeline.mixed(spark, make, sf_dir)
        assert mixed.columns == list(corpus_pipeline.COLUMNS) and {x.text for x in mixed.collect()} <= {x[1] for x in rows if x[1] and x[1].strip()}
        told = corpus_pipeline.tokens(spark, make, sf_dir).collect()
        assert len(told) == len(rows) and all(len(x.ids) == 0 for x in told if x.doc_id in (1, 2)) and max(len(x.ids) for x in told) > 30_000
        good = corpus_pipeline.good_quality(spark, make, sf_dir)
        assert good.columns == list(corpus_pipeline.COLUMNS) and set(map(tuple, good.collect())) <= set(rows)
    docs = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0 and (name == "tokens" or docs.columns == list(corpus_pipeline.COLUMNS))
