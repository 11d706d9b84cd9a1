"""Quality rules by host, in DataFrame functions alone.

Each text is measured once; rules on the measures tell which documents fail. Failures are counted by host (the
documents' source), a beta prior is fitted to the hosts' rates of each rule by moments, and each host's rate is drawn to
it according to how few documents the host has: its posterior mean and deviation. Two verdicts on a host are joined
back to its documents:

* rejected: the rate of some rule is above ``most`` even ``SURE`` deviations below its posterior mean. All documents of the
  host go, whatever they are themselves; a small host isn't rejected by a few failures.
* strict: the posterior mean of a rule is ``tolerated`` or more. Then documents of the host that fail this rule go; at hosts
  where it hardly ever fails, a single failure is taken for an oddity and forgiven. A host of few documents has about
  the prior's mean. The two base rules count everywhere.

Documents without a host are judged by the base rules alone.

Measures look at one text at a time and stay inside its row, so that no text and no host needs one task.

Results for odd input: no rows in, no rows out; null, empty and blank texts have no words and fail; long texts are
measured whole; repeated rows count each; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, only, table, word_split

WINDOW = 5


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a ``window``-word sequence found twice or more in the text."""

    def of_hashes(hashes: Column) -> Column:
        # Windows in order of hash, then those beside an equal one, then their places in order.
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(order, lambda o: F.filter(o, lambda x, j: (x["h"] == F.get(o, j - 1)["h"]) | (x["h"] == F.get(o, j + 1)["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")))["n"]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)

    def of_words(hashed: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashed) - window)
        return let(F.transform(at, lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(window)])), of_hashes)

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_words))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of each row of ``docs``."""
    x = only(docs, "doc_id", "text", "source").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    x = x.withColumn("words", word_split(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return x.select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


#: Rules by name; each says which measured documents fail.
RULES: dict[str, Column | str] = {
    "too_short": "n_words < 10",
    "repeats_itself": "100 * n_repeat_words > 20 * n_words",
}
#: Rules that count where a host's verdict says so.
SOFT_RULES: dict[str, str] = {
    "many_symbols": "n_symbols > n_words",
    "odd_word_length": "n_words > 0 AND (word_chars > 15 * n_words OR word_chars < 2 * n_words)",
    "repeated_lines": "n_dup_lines > 5 AND 10 * n_dup_lines > n_words",
}
HOST_RULES: dict[str, str] = RULES | SOFT_RULES
#: Deviations below the posterior mean at which a rate is still above a bound with 95% probability.
SURE = 1.645


def beta_prior(hosts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float]]:
    """Alpha and beta of each rule's failure rates over hosts, by moments; a handful of numbers."""
    found = hosts.agg(*[f(F.col(r) / F.col("n")).alias(f"{k}_{r}") for r in rules for k, f in (("mean", F.avg), ("var", F.var_pop))]).first()
    out = {}
    for r in rules:
        mean = min(max(found[f"mean_{r}"] or 0.0, 1e-6), 1 - 1e-6)
        strength = mean * (1 - mean) / max(found[f"var_{r}"] or 0.0, 1e-9) - 1
        strength = min(max(strength, 2.0), 10_000.0)
        out[r] = mean * strength, (1 - mean) * strength
    return out


def host_rules(docs: DataFrame, most: float = 0.5, tolerated: float = 0.01) -> DataFrame:
    """doc_id, source, measures, base_failed, host_rate, rejected, strict and kept of each row of ``docs`` (doc_id, text, source).

    host_rate is the largest posterior mean of the host's rules; strict lists the soft rules that count at the host.
    """
    measured = cut(measures(docs))
    measured = measured.withColumn("base_failed", F.expr(" OR ".join(f"({r})" for r in RULES.values())))
    hosts = measured.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.expr(rule)).alias(name) for name, rule in HOST_RULES.items()])
    drawn, surely = {}, []
    for r, (a, b) in beta_prior(hosts, list(HOST_RULES)).items():
        drawn[r] = (F.col(r) + a) / (F.col("n") + a + b)
        surely.append(drawn[r] - SURE * F.sqrt(drawn[r] * (1 - drawn[r]) / (F.col("n") + a + b + 1)) > most)
    strict = F.array_compact(F.array(*[F.when(drawn[r] >= tolerated, F.lit(r)) for r in SOFT_RULES]))
    verdicts = hosts.select("source", F.greatest(*drawn.values()).alias("host_rate"), reduce(Column.__or__, surely).alias("rejected"), strict.alias("strict"))
    out = measured.join(verdicts, "source", "left")
    fails = reduce(Column.__or__, [F.array_contains("strict", r) & F.expr(rule) for r, rule in SOFT_RULES.items()])
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("rejected") | fails, F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM d WHERE len(words) >= 5),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS five FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM w),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS word FROM r WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM p GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT d.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
long_ AS (
  SELECT source, 'a' AS rule, n_words < 10 AS bad FROM f UNION ALL SELECT source, 'b', 100 * n_repeat_words > 20 * n_words FROM f
  UNION ALL SELECT source, 'c', n_symbols > n_words FROM f
  UNION ALL SELECT source, 'd', n_words > 0 AND (word_chars > 15 * n_words OR word_chars < 2 * n_words) FROM f
  UNION ALL SELECT source, 'e', n_dup_lines > 5 AND 10 * n_dup_lines > n_words FROM f),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE bad) AS k FROM long_ WHERE source IS NOT NULL GROUP BY source, rule),
mo AS (SELECT rule, least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS mean, var_pop(k / n) AS v FROM h GROUP BY rule),
pr AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(v, 1e-9) - 1, 2.0), 10000.0) AS strength FROM mo),
q AS (SELECT source, rule, n + strength AS size, (k + mean * strength) / (n + strength) AS rate FROM h JOIN pr USING (rule)),
hr AS (SELECT source, bool_or(rate - 1.645 * sqrt(rate * (1 - rate) / (size + 1)) > 0.5) AS rejected, bool_or(rule = 'c' AND rate >= 0.01) AS c,
         bool_or(rule = 'd' AND rate >= 0.01) AS d, bool_or(rule = 'e' AND rate >= 0.01) AS e FROM q GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected OR (c AND n_symbols > n_words) OR (d AND n_words > 0 AND (word_chars > 15 * n_words OR word_chars < 2 * n_words))
    OR (e AND n_dup_lines > 5 AND 10 * n_dup_lines > n_words), false) AS kept
FROM f LEFT JOIN hr ON f.source = hr.source
"""
