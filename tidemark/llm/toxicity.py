"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, brings compatible forms together (full width, mathematical and ligature letters), drops joiners and
stray marks, turns look-alike letters and digits or signs that stand for letters into those letters, and all else but
letters into spaces. Accented letters stay, as they tell words apart; where an accented word begins no term, but does
without its accents, it is matched without them.

Lexicon terms are word beginnings, learned with their weights (smoothed log odds) from labelled texts. Words that begin
like a term, and such words together with the word before or after, are exception phrases where they are at home in
harmless texts: they are in the automaton too, the leftmost and then the longest match wins, and theirs counts nothing.
Known phrases can be given besides. The weights found are divided by the number of words, and a logistic curve fitted on
the same rows turns that rate into a score.

The lexicon is learned from at most ``FIT_ROWS`` labelled rows, one for each doc_id (of several the least text) and one for
each text; all candidates and exceptions they hold count. Without labels of both kinds it is empty.

Results for odd input: no rows in, no rows out; null, empty and blank texts have rate 0; time is in proportion to the
text; repeated rows get equal scores; a null doc_id stays null and isn't held out.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, labelled_sample, only, saved, sized_slices, table

FIT_ROWS = 12_000
#: Beginnings of words of 3 to 12 letters are terms, and every whole word.
SHORTEST, LONGEST = 3, 12
LEAST_WEIGHT = 3.0
#: Terms or exceptions that the driver holds; the fitted rows are bounded and give far fewer. More stop the fit, none is left out.
MOST_TERMS = 1_000_000
#: Harmless texts that a phrase must stand in to be an exception.
EXCEPTION_TEXTS = 2
#: Cyrillic, Greek, Armenian and other letters that look like Latin ones; then digits and signs that stand for letters.
LOOK_ALIKE = dict(
    zip(
        "абвгԁеһіјӏкмнорԛѕсԏтυѵԝхуғ" + "αβεηικνορτχωγ" + "օոսհցք" + "ıɑɡɩøđħłŧƀʏɴʀꜱᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍᴏᴘᴛᴜᴠᴡᴢ",
        "a6brdehijlkmhopqscttuvwxyf" + "abenikvoptxwy" + "onuhgp" + "iagiodhltbynrsabcdefghijklmoptuvwz",
        strict=True,
    )
)
STANDS_FOR = dict(zip("0134567@$!", "oieasbtasi", strict=True))
#: Combining marks, variation selectors, joiners and other characters without a width.
UNSEEN = [*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100), *range(0xFE00, 0xFE10), *range(0xFE20, 0xFE30), 0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF]


@functools.lru_cache(1)
def fold_table() -> dict[int, str | None]:
    return dict.fromkeys(UNSEEN) | {ord(k): v for k, v in (LOOK_ALIKE | STANDS_FOR).items()}


_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Folded words with one space before each and after the last."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {_OTHER.sub(' ', text.lower().translate(fold_table())).strip()} "


def bare(word: str) -> str:
    """A word without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


class Lexicon:
    """Weights of word beginnings, exception phrases, and the curve from rate to score."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], slope: float, offset: float):
        self.weights, self.exceptions, self.slope, self.offset = weights, exceptions, slope, offset
        self.lengths = sorted({len(t) for t in weights})
        self.forms: dict[str, str] = {}

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            a.add_word(f" {term}", weight)
        # The space that ends an exception begins the next word: two spaces let both match.
        for phrase in self.exceptions:
            a.add_word(f" {'  '.join(phrase.split())} ", 0.0)
        if len(a):
            a.make_automaton()
        return a

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"} | {"forms": {}}

    def begins(self, word: str) -> bool:
        """Whether a term begins the word."""
        return any(word[:n] in self.weights for n in self.lengths)

    def form(self, word: str) -> str:
        """What a word is matched as: without its accents where only so it begins a term."""
        got = self.forms.get(word)
        if got is None:
            plain = word if word.isascii() or self.begins(word) else bare(word)
            got = plain if self.begins(plain) else word
            if len(self.forms) >= 500_000:
                self.forms.clear()
            self.forms[word] = got
        return got

    def found(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights found, and the number of words."""
        words = fold(text).split()
        if not len(self.automaton):
            return 0.0, len(words)
        if not all(map(str.isascii, words)):
            words = list(map(self.form, words))
        return sum(w for _, w in self.automaton.iter_long(f" {'  '.join(words)} ")), len(words)

    def rate(self, text: str | None) -> float:
        """Weights found per word, on a log scale."""
        found, words = self.found(text)
        return math.log1p(100 * found / max(20, words))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * self.rate(text)))))


def counts_of(batches, of):
    """(term, clean, toxic): texts of each kind, of all those in the task, for which ``of`` gives a term."""
    counts: dict[str, list[int]] = {}

    def out():
        terms = list(counts)
        for at in range(0, len(terms), 10_000):
            some = terms[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([counts[t][0] for t in some], pa.int64()), pa.array([counts[t][1] for t in some], pa.int64())], ["term", "clean", "toxic"])
        counts.clear()

    for piece in sized_slices(batches, "text"):
        for text, label in zip(piece.column("text").to_pylist(), piece.column("label").to_pylist(), strict=True):
            for term in of(text):
                counts.setdefault(term, [0, 0])[label] += 1
        if len(counts) > 1_000_000:
            yield from out()
    yield from out()


def beginnings(text: str) -> set[str]:
    words = {w for w in fold(text).split() if len(w) >= SHORTEST}
    return words | {w[:i] for w in words for i in range(SHORTEST, min(LONGEST, len(w)) + 1)}


def phrases(text: str, lexicon: Lexicon) -> set[str]:
    """Words that begin like a term, alone and with the word before or after."""
    words = [lexicon.form(w) for w in fold(text).split()]
    out = set()
    for i, w in enumerate(words):
        if lexicon.begins(w):
            out |= {w, *([f"{words[i - 1]} {w}"] if i else []), " ".join(words[i : i + 2])}
    return out


def bounded(rows: DataFrame) -> list:
    """All rows, on the driver."""
    found = rows.limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: fit on fewer rows")
    return found


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, slightly drawn to zero."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2)
        w += np.linalg.solve(hessian, a.T @ (y - p) - 0.05 * w)
    return float(w[0]), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, bound: int = FIT_ROWS, known_exceptions: tuple[str, ...] = ()) -> Lexicon:
    """The lexicon of ``labels.toxic``. What comes to the driver is bounded by what ``bound`` rows hold."""
    sample = labelled_sample(docs, labels, "toxic", folds, held_out, bound)
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    # Copies of one text would lend its words support.
    sample = saved(sample.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label"))
    kinds = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = kinds.get(0, 0), kinds.get(1, 0)
    if not n0 or not n1:
        return Lexicon({}, [], 0.0, 30.0 if n1 else -30.0 if n0 else 0.0)

    def counted(of) -> DataFrame:
        return sample.mapInArrow(lambda b: counts_of(b, of), "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    support = max(4, round(0.006 * n1))
    odds = lambda toxic, clean: math.log((toxic + 0.5) / (n1 + 1)) - math.log((clean + 0.5) / (n0 + 1))
    strong = counted(beginnings).where((F.col("toxic") >= support) & (F.col("toxic") * F.lit(n0) >= 6 * F.col("clean") * F.lit(n1)))
    terms = {r["term"]: (r["toxic"], odds(r["toxic"], r["clean"])) for r in bounded(strong)}
    chosen: dict[str, float] = {}
    for term, (toxic, weight) in sorted(terms.items(), key=lambda x: (len(x[0]), x[0])):
        if weight >= LEAST_WEIGHT and not any(t.startswith(term) or term.startswith(t) for t in chosen):
            # The longest beginning that nearly all of its texts share says it most exactly.
            longest = max((t for t in terms if t.startswith(term) and terms[t][0] >= 0.95 * toxic), key=lambda t: (len(t), t))
            chosen[longest] = terms[longest][1]
    exceptions = [" ".join(fold(p).split()) for p in known_exceptions]
    lexicon = Lexicon(chosen, exceptions, 1.0, 0.0)
    if chosen:
        homely = counted(lambda text: phrases(text, lexicon)).where(F.col("clean") >= EXCEPTION_TEXTS)
        homely = homely.where((F.col("toxic") + 0.5) * F.lit(n0 + 1) < 2 * (F.col("clean") + 0.5) * F.lit(n1 + 1))
        exceptions += [r["term"] for r in bounded(homely)]
    lexicon = Lexicon(chosen, sorted(set(exceptions)), 1.0, 0.0)

    def rates(batches):
        for piece in sized_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column("label"), pa.array([lexicon.rate(t) for t in piece.column("text").to_pylist()], pa.float64())], ["label", "rate"])

    rows = sample.mapInArrow(rates, "label int, rate double").toPandas().sort_values(["label", "rate"])
    lexicon.slope, lexicon.offset = logistic(rows["rate"].to_numpy(float), rows["label"].to_numpy(float))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text)."""

    def rows(batches):
        for piece in sized_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array([lexicon.score(t) for t in piece.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(rows, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels, folds, held_out))
    return scored.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
