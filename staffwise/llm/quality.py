"""Quality rules as weak supervision (DataFrame functions only).

Rules vote good or poor on a document, or abstain. Their accuracies are
estimated without labels by expectation-maximisation: each document is of an
unseen class, good or poor; each rule that votes on it votes rightly with its
accuracy for that class. The votes of all documents are counted by pattern (at
most a few thousand, whatever the input), so an iteration touches that table only.
A document is kept if its posterior probability of being good is one half or
more and it passes the base rules.

All measures of a text are computed within its row; nothing is shuffled but
the counts of vote patterns.

Defined results: a null text has no words; rows with no vote have the prior as
posterior; an empty table gives an empty result; repeated rows count as often
as they occur; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, staged

RULES = ["symbols", "letters", "letterless_words", "word_length", "repeated_words", "vocabulary", "repeated_lines", "capitals",
         "length"]
#: Bounds of the accuracies. On good documents a rule is no worse than chance:
#: rules that only speak against documents have no right vote there to count.
GOOD_ACCURACY = (0.5, 0.999)
POOR_ACCURACY = (0.05, 0.999)
PRIOR = (0.5, 0.99)


def _covered(windows: Column) -> Column:
    """Positions covered by three-word windows whose hash occurs twice or more.

    (hash, place) pairs are sorted, those equal to a neighbour kept, and their
    places walked in order: each adds what it reaches beyond the last."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # an array of one array: its lambda holds the sorted pairs without sorting them again
    repeated = F.get(F.transform(F.array(pairs), lambda s: F.filter(
        F.transform(s, lambda x, j: F.struct(
            x["i"].alias("i"),
            (F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
             | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))).alias("again"))),
        lambda x: x["again"])), F.lit(0))
    places = F.array_sort(F.transform(repeated, lambda x: x["i"]))
    walked = F.aggregate(
        places, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct((i + 3).alias("end"),
                                (acc["n"] + (i + 3 - F.greatest(acc["end"], i))).alias("n")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")) \
        .otherwise(walked["n"])


def measures(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Per document: row (a struct of the columns ``keep``, by default all),
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and, for the
    rules, _lines, _capitals, _letters, _letterless, _distinct. Columns of
    ``docs`` are in the struct only, so their names are free."""
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"), "text")
    # each step's arrays are columns of their own, so that later expressions
    # read them instead of computing them again
    split = docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn(
        "_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))).withColumn(
        "_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)))
    n = F.size("_w")
    hashed = split.withColumn("_h", F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
        .otherwise(F.array().cast("array<bigint>")))
    return hashed.select(
        "row", n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_h")).alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
        F.char_length(F.regexp_replace("_t", r"[^A-ZÀ-ÖØ-Þ]+", "")).alias("_capitals"),
        F.char_length(F.regexp_replace("_t", r"[^\p{L}]+", "")).alias("_letters"),
        F.size(F.filter("_w", lambda x: ~x.rlike(r"\p{L}"))).alias("_letterless"),
        F.size(F.array_distinct("_w")).alias("_distinct"))


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 poor, 0 abstains. The last three speak
    only against documents."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))

    def by(share: Column, good: float, poor: float) -> Column:
        return F.when(share <= good, 1).when(share > poor, -1).otherwise(0)

    said = {
        "symbols": by(F.col("n_symbols") / words, 0.02, 0.10),
        "letters": by(1 - F.col("_letters") / chars, 0.08, 0.20),
        "letterless_words": by(F.col("_letterless") / words, 0.10, 0.25),
        "word_length": by(F.col("word_chars") / words, 6.2, 7.0),
        "repeated_words": by(F.col("n_repeat_words") / words, 0.15, 0.30),
        "vocabulary": by(1 - F.col("_distinct") / words, 0.60, 0.75),
        "repeated_lines": F.when((F.col("_lines") >= 3) & (F.col("n_dup_lines") / F.greatest(
            F.col("_lines"), F.lit(1)) > 0.5), -1).otherwise(0),
        "capitals": F.when(F.col("_capitals") / chars > 0.4, -1).otherwise(0),
        "length": F.when(F.col("n_words") < 50, -1).otherwise(0),
    }
    return {k: F.when(F.col("n_words") == 0, 0).otherwise(v).cast("int") for k, v in said.items()}


def estimate(patterns: list[tuple[tuple[int, ...], int]], tolerance: float = 1e-9) -> dict:
    """Class share and accuracies by expectation-maximisation from counted vote
    patterns: {"prior": p, "good": [...], "poor": [...]}, where good[r] is the
    probability that rule r's vote on a good document is right."""
    rules = len(patterns[0][0]) if patterns else len(RULES)
    prior, good, poor = 0.9, [0.98] * rules, [0.6] * rules

    def clip(x, a, b):
        return min(b, max(a, x))

    while True:
        right = [[1.0, 1.0] for _ in range(rules)]  # one vote of each kind before any is seen
        cast = [[2.0, 2.0] for _ in range(rules)]
        share, total = 9.0, 10.0
        for pattern, n in patterns:
            p = posterior(pattern, prior, good, poor)
            share, total = share + n * p, total + n
            for r, v in enumerate(pattern):
                if v:
                    right[r][0] += n * p * (v > 0)
                    right[r][1] += n * (1 - p) * (v < 0)
                    cast[r][0] += n * p
                    cast[r][1] += n * (1 - p)
        new_prior = clip(share / total, *PRIOR)
        new_good = [clip(x[0] / y[0], *GOOD_ACCURACY) for x, y in zip(right, cast)]
        new_poor = [clip(x[1] / y[1], *POOR_ACCURACY) for x, y in zip(right, cast)]
        moved = max(abs(a - b) for a, b in zip([new_prior, *new_good, *new_poor], [prior, *good, *poor]))
        prior, good, poor = new_prior, new_good, new_poor
        if moved < tolerance:
            return {"prior": prior, "good": good, "poor": poor}


def posterior(pattern: tuple[int, ...], prior: float, good: list[float], poor: list[float]) -> float:
    x = math.log(prior / (1 - prior))
    for v, g, q in zip(pattern, good, poor):
        if v > 0:
            x += math.log(g / (1 - q))
        elif v < 0:
            x += math.log((1 - g) / q)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def probability(model: dict) -> Column:
    """The posterior probability of a good document, of vote columns _v_<rule>."""
    x = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for rule, g, q in zip(RULES, model["good"], model["poor"]):
        v = F.col(f"_v_{rule}")
        x = x + F.when(v > 0, math.log(g / (1 - q))).when(v < 0, math.log((1 - g) / q)).otherwise(0.0)
    return 1 / (1 + F.exp(-x))


def count_patterns(voted: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """Vote patterns of all documents with their counts (3 to the number of rules at most)."""
    names = [f"_v_{r}" for r in RULES]
    return sorted((tuple(r[n] for n in names), r["n"])
                  for r in voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect())


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (a struct of the columns ``keep``), the measures, base_failed,
    quality (posterior) and kept. Measures are staged once; both the counts of
    votes and the verdicts read them from there."""
    voted = staged(measures(docs, keep).select("row", *MEASURES, *[v.alias(f"_v_{k}") for k, v in votes().items()]),
                   "quality")
    model = estimate(count_patterns(voted))
    return (voted.withColumn("base_failed", base_failed()).withColumn("quality", probability(model))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
            .drop(*[f"_v_{r}" for r in RULES]))


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the measures, base_failed, quality and kept."""
    return judged(docs, ["doc_id"]).select("row.doc_id", *MEASURES, "base_failed", "quality", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass the base rules and are probably good; all
    columns as they are, whatever their names."""
    return judged(docs, docs.columns).filter("kept").select("row.*")
