"""Phrases, centroids and pieces against brute force and the library, on odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import centroids, phrases, piece_bpe


def brute_collocations(docs, least, longest, best):
    """The contract of op11, word by word."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang, text = "und" if lang is None else lang, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, words), a in f.items():
        if len(words) < 2 or any(x[0] == lang and len(x[1]) > len(words) and v >= a and any(x[1][i : i + len(words)] == words for i in range(len(x[1]))) for x, v in f.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:best]))


ODD_TEXTS = [
    ("en", None), ("en", ""), (None, " \t\n.,"), ("und", "a b a b a b"), (None, "A B A b. a b"), ("en", "é É日 x\x1cy é É日 x\x1cy"), ("fr", "a a a a a a a a"), ("en", "a a a a a a a a"), ("en", "a a a a a a a a"),
    ("en", " ".join(f"w{i % 7}" for i in range(30_000))),
]


def corpus(seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice("abcdAB") + r.choice(["", "", " ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(r.randint(0, 60)))
    return [(r.choice(["en", "en", "de", None]), text()) for _ in range(150)] + ODD_TEXTS


@pytest.mark.parametrize(("seed", "least", "longest", "best"), [(1, 5, 5, 2000), (2, 12, 4, 7), (3, 100, 5, 3)])
def test_collocations_by_brute_force(spark, seed, least, longest, best):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 AS k", "'x' AS phrase", "2 AS part", "3 AS n", "4 AS rank").repartition(3)
    got = [tuple(r) for r in phrases.collocations(df, least, longest, best).collect()]
    assert sorted(got) == brute_collocations(docs, least, longest, best)


def test_collocations_without_rows(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    with pytest.raises(ValueError, match="255"):
        phrases.frequent_phrases(empty, least=300)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """A word hash of three values: counts stay exact, as the words themselves are compared."""
    monkeypatch.setattr(phrases, "word_hash", lambda word, lang: len(word) % 3)
    docs = corpus(4)
    block, every = phrases.Block(), np.full(1 << (phrases.BITS - 3), 255, np.uint8)
    for lang, text in docs:
        block.add(text or "", lang or "und")
    for k in (1, 2, 3):
        rows = [r for b in block.counts(k, every, every, 3) for r in b.to_pylist() if r["phrase"] is not None]
        want = Counter()
        for lang, text in docs:
            for piece in (text or "").encode().lower().translate(phrases.ENDS).split(b"."):
                words = piece.decode().split(" ")
                words = [w for w in words if w]
                want.update((lang or "und", " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
        assert len(rows) == len(want)
        assert {(r["lang"], r["phrase"]): r["f"] for r in rows} == want


def test_bitmaps_decide():
    """Bitmaps of ones, as on an input that fills all buckets, let everything be counted; of zeros, nothing."""
    docs = corpus(5)
    block, every = phrases.Block(), np.full(1 << (phrases.BITS - 3), 255, np.uint8)
    none = np.zeros(1 << (phrases.BITS - 3), np.uint8)
    for lang, text in docs:
        block.add(text or "", lang or "und")
    assert sum(b.num_rows for b in block.counts(2, every, every, 2)) > 0
    assert not list(block.counts(2, every, none, 2))
    assert not list(block.counts(2, none, every, 2))


def plain_nearest(x, c):
    d = [[sum((a - b) ** 2 for a, b in zip(row, cent, strict=True)) for cent in c] for row in x]
    return [row.index(min(row)) for row in d], [min(row) for row in d]


@pytest.mark.parametrize("size", [3, 1 << 11, 1 << 24, 1 << 29, 1 << 45, 1 << 70])
def test_nearest_by_plain_integers(size):
    r = random.Random(size)
    x = [[r.randint(-size, size) for _ in range(64)] for _ in range(40)] + [[0] * 64, [r.randint(-3, 3) for _ in range(64)]]
    c = x[:3] + [x[1]] + [[r.randint(-size, size) for _ in range(64)] for _ in range(3)]
    kind = object if size >= centroids.LONG else np.int64
    at, far = centroids.nearest(np.array(x, kind), np.array(c, kind))
    want = plain_nearest(x, c)
    assert (at.tolist(), [int(v) for v in far]) == want
    sums = centroids.cluster_sums(np.array(x, kind), at, 7)
    assert [[int(v) for v in row] for row in sums] == [[sum(row[j] for row, i in zip(x, at, strict=True) if i == k) for j in range(64)] for k in range(7)]


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    order = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1]))
    cent = [v for _, v in order[:k]]
    for _ in range(rounds):
        at, _ = plain_nearest([v for _, v in kept], cent)
        for j in range(len(cent)):
            mine = [v for (_, v), i in zip(kept, at, strict=True) if i == j]
            if mine:
                cent[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    at, far = plain_nearest([v for _, v in kept], cent)
    fit = lambda n: n if n < 1 << 63 else None
    inertia = [sum(d for d, i in zip(far, at, strict=True) if i == j) for j in range(len(cent))]
    return [(i, j, fit(d), fit(inertia[j]), fit(sum(inertia)), hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest()) for (i, _), j, d in zip(kept, at, far, strict=True)]


@pytest.mark.parametrize("wide", [None, 3e5, 3e38])
def test_clusters_by_brute_force(spark, wide):
    r = random.Random(7)
    vector = lambda s=1.0: [r.gauss(0, s) for _ in range(64)]
    rows = [(i, vector()) for i in range(60)]
    rows += [(60, None), (61, []), (62, vector()[:63]), (63, vector() + [1.0]), (64, [None] + vector()[:63]), (65, [float("nan")] + vector()[:63]), (66, [float("inf")] + vector()[:63])]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (7, vector()), (None, vector()), (70, [0.0] * 64), (71, [-0.0] * 64), (72, [1e-9] * 64)]
    if wide:
        rows += [(80 + i, [r.choice([-1, 1]) * wide * r.random() for _ in range(64)]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS v", "'x' AS cluster", "2 AS wide").repartition(3)
    got = [tuple(x) for x in centroids.centroid_clusters(df).collect()]
    say = lambda rows: sorted(map(repr, rows))
    assert say(got) == say(brute_clusters(rows, 8, 10))


def test_clusters_of_few_vectors(spark):
    rows = [(1, [1.0] * 64), (2, [2.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert sorted(tuple(x) for x in centroids.centroid_clusters(df).collect()) == sorted(brute_clusters(rows, 8, 10))
    assert centroids.centroid_clusters(df.where("false")).count() == 0


def piece_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_file())


def odd_pieces():
    r = random.Random(3)
    letters = "ab  ab▁é日本①Ａ\n\t\x00 　😀eth12=-.,ing the"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += [c * n for c in "a= ▁1日\n①" for n in (1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31, 33, 64, 100)]
    texts += ["ab" * 300, "日本語" * 200, "".join(r.choice("aab") for _ in range(2000)), "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "<s></s><unk><0x41>", "é ﬁ"]
    return texts


def test_pieces_by_the_library(library):
    bpe, texts = piece_bpe.PieceBpe(piece_file()), odd_pieces()
    got = bpe.encode(texts)
    assert [x.tolist() for x in got] == [library.encode(t) for t in texts]
    assert [bpe.decode(x) for x in got] == [library.decode(x.tolist()) for x in got]
    fresh = piece_bpe.PieceBpe(piece_file())  # one word at a time, nothing remembered
    assert all(fresh.encode_words([w])[0].tobytes() == bpe.known[w] for w in list(bpe.known)[:300])


def test_forgotten_words(monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "REMEMBER", 50)
    bpe, texts = piece_bpe.PieceBpe(piece_file()), odd_pieces()[:400]
    assert [bpe.encode([t])[0].tolist() for t in texts] == [library.encode(t) for t in texts]


def test_decoding_any_ids(library):
    r, bpe = random.Random(5), piece_bpe.PieceBpe(piece_file())
    for _ in range(2000):
        ids = [r.randrange(32000) if r.random() < 0.6 else r.randrange(300) for _ in range(r.randint(0, 12))]
        assert bpe.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_pieces_of_tables(spark, library):
    rows = [(1, None), (2, ""), (3, " "), (4, "one"), (5, "Two  words é"), (5, "Two  words é"), (None, "x"), (7, " ".join(f"w{i % 977}" for i in range(40_000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "'x' AS n_tokens")
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    say = lambda rows: sorted(map(repr, rows))
    assert say(tuple(r) for r in piece_bpe.encode_digests(df, piece_file()).collect()) == say(want)
    back = piece_bpe.decode_column(piece_bpe.encode_column(df, piece_file()), piece_file())
    assert say((r.doc_id, r.text) for r in back.collect()) == say((i, t or "") for i, t in rows)
    assert piece_bpe.encode_digests(df.where("false"), piece_file()).count() == 0
