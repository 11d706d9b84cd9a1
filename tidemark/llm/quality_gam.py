"""Document quality by a generalised additive model with pairwise interactions.

Each text gives a few shape features, cut into quantile bins. Cyclic boosting visits the features in turn and adds to
each feature's lookup table a shallow tree fitted to the remaining logistic gradient; then the pairs that still
explain most get two-way tables, boosted likewise. A score is the sum of table entries at the row's bins.

The model is fitted on at most ``FIT_ROWS`` labelled rows, one for each doc_id (of several the one whose features
come first in order). Without labels of both kinds every score is the share of
good labels, 0.5 where there is none.

Results for odd input: no rows in, no rows out; null, empty and blank texts have the features of an empty text and a
score like any other; features cost time in proportion to the text; repeated rows get equal scores; a null doc_id
stays null and isn't held out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, labelled_sample, only, sized_slices, table

FIT_ROWS = 12_000
BINS = 32
FEATURES = (
    "log_words", "word_length", "letters", "upper", "digits", "marks", "word_enders", "distinct_words", "top_word",
    "repeated_next", "bare_words", "short_words", "line_words", "repeated_lines", "distinct_pairs", "longest_word",
)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"#*$%&|<>{}[]\\^~=+_@!")] = True


def features(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    letters = int(seen[_LETTER].sum())
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), float(lengths.mean()), letters / size, int(seen[65:91].sum()) / max(1, letters), int(seen[48:58].sum()) / size,
        int(seen[_MARK].sum()) / size, sum(1 for x in words if not x[-1:].isalnum() and x[-1] < 128) / n, len(counts) / n, max(counts.values()) / n,
        same / n, sum(1 for x in words if len(x) == 1 and not x.isalnum()) / n, int((lengths <= 3).sum()) / n, n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), float(lengths.max()),
    ]


def feature_rows(batches, *carried: str):
    for piece in sized_slices(batches, "text"):
        x = [features(t) for t in piece.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in carried], pa.array(x, pa.list_(pa.float64()))], [*carried, "x"])


class Gam:
    """Bin edges, one lookup table a feature, and two-way tables of some pairs."""

    def __init__(self, rounds: int = 60, pair_rounds: int = 20, pairs: int = 8, rate: float = 0.15):
        self.rounds, self.pair_rounds, self.n_pairs, self.rate = rounds, pair_rounds, pairs, rate
        self.base, self.edges, self.tables, self.pairs = 0.0, [np.zeros(0)] * len(FEATURES), np.zeros((len(FEATURES), BINS)), []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = self.base + sum(self.tables[j][b[:, j]] for j in range(b.shape[1]))
        for i, j, t in self.pairs:
            total = total + t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        share = y.mean() if len(y) else 0.5
        if not len(y) or not 0 < share < 1:
            self.base = 20.0 * (2 * share - 1) if len(y) else 0.0
            return self
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
        b = self.bins(x)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j in range(x.shape[1]):
                step = self.rate * shallow_tree(*self.sums(b[:, j], y, f, BINS), depth=2)
                self.tables[j] += step
                f += step[b[:, j]]
        both = [(i, j) for i in range(x.shape[1]) for j in range(i)]
        gains = [(pair_tree(*self.sums(b[:, i] * BINS + b[:, j], y, f, BINS * BINS))[1], i, j) for i, j in both]
        self.pairs = [(i, j, np.zeros((BINS, BINS))) for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for i, j, t in self.pairs:
                step = self.rate * pair_tree(*self.sums(b[:, i] * BINS + b[:, j], y, f, BINS * BINS))[0]
                t += step
                f += step[b[:, i], b[:, j]]
        return self

    @staticmethod
    def sums(at: np.ndarray, y: np.ndarray, f: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return np.bincount(at, y - p, n), np.bincount(at, p * (1 - p), n)


PENALTY = 4.0


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + PENALTY) + (g.sum() - a) ** 2 / (h.sum() - b + PENALTY)
    k = int(gain.argmax())
    return float(gain[k] - g.sum() ** 2 / (h.sum() + PENALTY)), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values, bin by bin, of a tree of that depth on one feature."""
    if depth and len(g) > 1:
        gain, k = best_split(g, h)
        if gain > 0:
            return np.concatenate([shallow_tree(g[:k], h[:k], depth - 1), shallow_tree(g[k:], h[k:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + PENALTY))


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values of a tree that cuts one feature, then each side by the other; and its gain."""
    g, h = g.reshape(BINS, BINS), h.reshape(BINS, BINS)
    best, out = -1.0, np.zeros((BINS, BINS))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, k = best_split(a.sum(1), b.sum(1))
        leaf, gain = np.zeros((BINS, BINS)), 0.0
        for side in (slice(0, k), slice(k, BINS)):
            more, m = best_split(a[side].sum(0), b[side].sum(0))
            gain += more
            for part in (slice(0, m), slice(m, BINS)):
                leaf[side, part] = a[side, part].sum() / (b[side, part].sum() + PENALTY)
        if gain > best:
            best, out = gain, leaf.T if turned else leaf
    return out, best


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, bound: int = FIT_ROWS) -> Gam:
    """The model of ``labels.quality``; at most ``bound`` rows of features come to the driver."""
    sample = labelled_sample(docs, labels, "quality", folds, held_out, bound)
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(lambda b: feature_rows(b, "doc_id", "label"), f"doc_id {kind}, label int, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("x").alias("x")).select("label", "x").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    y = rows["label"].to_numpy(float)
    order = np.lexsort([*x.T, y])  # rows come in any order
    return Gam().fit(x[order], y[order])


def score_quality(docs: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text)."""

    def rows(batches):
        for piece in feature_rows(batches, "doc_id"):
            x = piece.column("x").flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    scored = score_quality(docs, fit_quality(docs, labels, folds, held_out))
    return scored.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
