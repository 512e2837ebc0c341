"""Weak supervision of document quality, with DataFrame operations only.

Rules vote good or bad on a document, or abstain. Expectation-maximisation over the counts of vote patterns (there are
at most ``3 ** rules`` of them, whatever the corpus) estimates how often each rule is right and how common good
documents are; the posterior probability of "good" given the votes replaces a filter that demands every rule. The classes
are told apart by which rules vote together: bad documents draw several bad votes, and a bad vote on its own, against
all others, seldom decides.

Everything of a text is computed within its row. Repeated five-word windows are found by 64-bit window hashes, sorted
within the row; so texts of any length cost n log n, and no window leaves its row.

Defined results: a null or empty text has no words: ``base_failed`` is true and ``kept`` false. Repeated rows and null
ids stay; further columns are not read. Equal posteriors decide alike: ``kept`` needs 0.5 or more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialize, read

WINDOW = 5
ROUNDS = 60
#: What is believed of every rule before the votes are seen: P(votes good | good), P(votes good | bad) and P(good). These
#: beliefs count as a hundredth of a rule's votes, so the data decide, alike at every size; they only tell good from bad.
PRIOR_GOOD, PRIOR_BAD, PRIOR_SHARE, STRENGTH = 0.95, 0.5, 0.85, 0.01
#: Frequent short words of the languages expected; a rule counts them.
COMMON_WORDS = ("the", "of", "and", "to", "in", "is", "that", "de", "la", "le", "les", "et", "el", "que", "los", "un", "der", "die", "und", "den", "das", "en", "a", "è", "y")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words lie in five-word windows that the text holds twice or more."""

    def windows(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.size(w) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))

    def covered(hashes: Column) -> Column:
        rows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(rows, lambda s: F.filter(s, lambda r, k: (F.get(s, k - 1)["h"] == r["h"]) | F.coalesce(F.get(s, k + 1)["h"] == r["h"], F.lit(False))))
        starts = F.array_sort(F.transform(twice, lambda r: r["i"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows(w), count)))


def measures(documents: DataFrame) -> DataFrame:
    """The numbers that the rules look at, a row a document."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    only = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", ""))
    frame = documents.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    return frame.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        only("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        only(r"\p{Lu}").cast("long").alias("n_upper"),
        only("!").cast("long").alias("n_shouts"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*COMMON_WORDS))).cast("long").alias("n_common"),
    )


def _vote(good: Column, bad: Column) -> Column:
    """1 for good, -1 for bad, 0 to abstain."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(m: DataFrame) -> DataFrame:
    """One column ``v_<rule>`` for each rule."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    mean, symbols = F.col("word_chars") / words, F.col("n_symbols") / words
    upper, distinct = F.col("n_upper") / chars, F.col("n_distinct") / words
    repeats, lines = F.col("n_repeat_words") / words, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    enough = F.col("n_words") >= 20
    common = F.col("n_common") / words
    rules = {
        "symbols": _vote(symbols < 0.02, symbols > 0.1),
        "case": _vote(upper < 0.06, upper > 0.3),
        "repeats": _vote(repeats < 0.02, repeats > 0.1),
        "lines": _vote((F.col("n_lines") >= 3) & (lines == 0), lines > 0.2),
        "variety": _vote(enough & (distinct > 0.5), enough & (distinct < 0.25)),
        "word_length": _vote(mean.between(4.0, 6.2), (mean < 3.0) | (mean > 7.0)),
        "common": _vote(common > 0.1, enough & (common < 0.03)),
        "shouting": _vote(F.col("n_shouts") / words < 0.02, F.col("n_shouts") / words > 0.2),
        "length": _vote(F.col("n_words") >= 100, F.col("n_words") < 30),
    }
    return m.withColumns({f"v_{name}": vote for name, vote in rules.items()})


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """From vote patterns and their counts: P(good), and for each rule P(votes good | good) and P(votes good | bad)
    among its votes. Expectation-maximisation from the prior beliefs, which keep a small weight: no rule's accuracy is
    fixed or bounded, so a rule that often votes against documents which the others find good comes to count little."""
    if not patterns:
        return 0.5, []
    total, prior = sum(c for _, c in patterns), PRIOR_SHARE
    rates = [(PRIOR_GOOD, PRIOR_BAD)] * len(patterns[0][0])
    for _ in range(rounds):
        good = [posterior(p, prior, rates) for p, _ in patterns]
        prior = (sum(g * c for g, (_, c) in zip(good, patterns)) + STRENGTH * total * PRIOR_SHARE) / (total * (1 + STRENGTH))
        found = []
        for r in range(len(rates)):
            seen = [(g, c, p[r] > 0) for g, (p, c) in zip(good, patterns) if p[r]]
            k = STRENGTH * sum(c for _, c, _ in seen) + 1e-9
            a = (sum(g * c for g, c, up in seen if up) + k * PRIOR_GOOD) / (sum(g * c for g, c, _ in seen) + k)
            b = (sum((1 - g) * c for g, c, up in seen if up) + k * PRIOR_BAD) / (sum((1 - g) * c for g, c, _ in seen) + k)
            found.append((a, b))
        rates = found
    return prior, rates


def posterior(pattern: tuple[int, ...], prior: float, rates: list[tuple[float, float]]) -> float:
    """P(good | votes), rules being independent given the class."""
    odds = math.log(prior / (1 - prior))
    for v, (a, b) in zip(pattern, rates):
        if v:
            odds += math.log(a / b) if v > 0 else math.log((1 - a) / (1 - b))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(documents: DataFrame) -> DataFrame:
    """All measures, the votes, ``posterior``, ``base_failed`` and ``kept`` of every row."""
    scored = votes(materialize(measures(documents), "rules-measures"))
    names = [c for c in scored.columns if c.startswith("v_")]
    counts = scored.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** rules rows
    patterns = sorted((tuple(int(r[c]) for c in names), r["n"]) for r in counts)
    prior, rates = estimate(patterns)
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, (a, b) in zip(names, rates):
        odds = odds + F.when(F.col(name) > 0, math.log(a / b)).when(F.col(name) < 0, math.log((1 - a) / (1 - b))).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = scored.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return judge(read(spark, sf_dir, "documents")).select(*columns)
