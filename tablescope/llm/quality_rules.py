"""Quality rules with risk-controlled thresholds.

Base rules reject a document outright. The other rules compare a metric with a cutoff. In each stratum the
cutoffs of all rules are tightened step by step along a fixed path, from the most lenient cutoffs of the
grid to the strictest ones, and each step tests the verdict of all rules together: labelled good documents
must prove, by an exact binomial bound, that at most a given share of good documents is rejected. The
path ends before the first step without proof; as its order is fixed, a true error needs that the first
step beyond the share is passed, so no correction is due inside a stratum and only strata share the error
probability (Bonferroni). With 4 strata the first proof takes 217 good labels and no rejection.

Defined results: a null text is the empty text; a null stratum is a stratum of its own; a document
without labels, or a stratum with too few labels to prove anything, is judged by the base rules alone;
of repeated labels of one document the best counts; repeated documents are judged alike, row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.shared import WORD, materialize, small, text_of, words_of

#: Metric of each rule and the cutoffs tried, strictest first; a document fails a rule above the cutoff.
GRID = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0),
    "exclamations_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0),
    "upper_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "repeat_word_share": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "mean_word_chars": (5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
}
#: Share of a stratum's good documents that the rules may reject together.
MAX_FALSE_REJECTION = 0.02
#: Probability that any of these guarantees fails.
ERROR_PROBABILITY = 0.05
#: Thresholds are broadcast below this number of strata.
BROADCAST_STRATA = 10_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the array ``__words``: words in 3-word windows found at least twice.

    Windows are sorted by a 64-bit hash inside the row, so equal ones meet; no row leaves its task.
    Each step reads its array several times, which keeps the optimizer from repeating the step inside.
    """
    window = lambda i: F.struct(
        F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)).alias("h"), i.alias("i")
    )
    starts = F.when(F.size("__words") >= 3, F.sequence(F.lit(0), F.size("__words") - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("__windows", F.sort_array(F.transform(starts, window)))
    at = lambda j: F.get("__windows", j)["h"]
    found_twice = lambda x, j: x["h"].eqNullSafe(at(j - 1)) | x["h"].eqNullSafe(at(j + 1))
    df = df.withColumn("__twice", F.sort_array(F.transform(F.filter("__windows", found_twice), lambda x: x["i"])))
    covered = F.transform("__twice", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("__twice", j + 1) - i, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("__windows", "__twice")


def quality_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of every whole text, ``base_failed`` and the metric of each rule."""
    df = docs.withColumn("__text", text_of(text))
    df = df.withColumn("__words", words_of(F.col("__text")))
    df = _repeat_words(df)
    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike(WORD))
    df = df.withColumn("__lines", lines)
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__upper": F.regexp_count("__text", F.lit(r"\p{Lu}")),
            "__exclamations": F.regexp_count("__text", F.lit("!")),
            "__n_lines": F.size("__lines"),
        }
    )
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    return df.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "symbols_per_word": share(F.col("n_symbols"), F.col("n_words")),
            "exclamations_per_word": share(F.col("__exclamations"), F.col("n_words")),
            "upper_share": share(F.col("__upper"), F.col("word_chars")),
            "dup_line_share": share(F.col("n_dup_lines"), F.col("__n_lines")),
            "repeat_word_share": share(F.col("n_repeat_words"), F.col("n_words")),
            "mean_word_chars": share(F.col("word_chars"), F.col("n_words")),
        }
    ).drop("__text", "__words", "__lines", "__upper", "__exclamations", "__n_lines")


def binomial_tail(n: Column, k: Column, p: float | Column) -> Column:
    """log P(X <= k) for X ~ Binomial(n, p), summed exactly in log space."""
    p = F.lit(p) if isinstance(p, float) else p
    first = n * F.ln(1 - p)
    odds = F.ln(p) - F.ln(1 - p)

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.ln(n - j + 1) - F.ln(j) + odds
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("total"))
    return F.aggregate(steps, start, add, lambda acc: acc["total"])


def tightening(grid: dict[str, tuple[float, ...]]) -> list[tuple[str, float]]:
    """The steps of the path: every rule's most lenient cutoff in the order of the rules, then the next ones."""
    depth = max(map(len, grid.values()), default=0)
    return [(rule, cutoffs[-1 - i]) for i in range(depth) for rule, cutoffs in grid.items() if i < len(cutoffs)]


def thresholds(
    metrics: DataFrame,
    labels: DataFrame,
    key: str,
    stratum: str,
    good: str = "quality",
    grid: dict[str, tuple[float, ...]] = GRID,
    max_false_rejection: float = MAX_FALSE_REJECTION,
    error_probability: float = ERROR_PROBABILITY,
) -> DataFrame:
    """One row per stratum with the proven cutoff of each rule (null: none proven)."""
    holdout = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(good).alias("__good")).where("__good = 1")
    held = metrics.where("not base_failed").select(key, stratum, *grid).join(holdout.select(key), key, "left_semi")
    path = tightening(grid)
    failing = lambda rule: F.coalesce(*[F.when(F.col(rule) > cutoff, F.lit(i)) for i, (r, cutoff) in enumerate(path) if r == rule])
    # the first step that rejects a document; all later ones do too
    first = held.groupBy(stratum, F.array_min(F.array(*map(failing, grid))).alias("__step")).agg(F.count(F.lit(1)).alias("__n"))
    rejected = [F.sum(F.when(F.col("__step") <= i, F.col("__n")).otherwise(0)) for i in range(len(path))]
    counts = materialize(first.groupBy(stratum).agg(F.sum("__n").alias("n"), F.array(*rejected).alias("rejected")), "holdout")
    enough = math.log(error_probability / max(1, counts.count()))

    def proven(k: Column) -> Column:
        return (k <= max_false_rejection * F.col("n")) & (binomial_tail(F.col("n"), k, max_false_rejection) <= enough)

    unproven = F.array_position(F.transform("rejected", proven), False)
    counts = materialize(counts.withColumn("steps", F.when(unproven == 0, len(path)).otherwise(unproven - 1)), "steps")

    def strictest(rule: str) -> Column:
        reached = [F.when(F.col("steps") > i, F.lit(cutoff)) for i, (r, cutoff) in enumerate(path) if r == rule]
        return F.coalesce(*reversed(reached)).cast("double").alias(f"cut_{rule}")

    return counts.select(stratum, F.col("n").alias("n_good"), *map(strictest, grid))


def with_verdict(metrics: DataFrame, cuts: DataFrame, stratum: str, grid: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """``metrics`` with the cutoffs of its stratum and ``kept``."""
    cuts = cuts.drop("n_good").withColumnRenamed(stratum, "__stratum")
    joined = metrics.join(small(cuts, BROADCAST_STRATA), F.col(stratum).eqNullSafe(F.col("__stratum")), "left").drop("__stratum")
    failed = F.lit(False)
    for rule in grid:
        failed = failed | F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~failed)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    grid: dict[str, tuple[float, ...]] = GRID,
    **risk: float,
) -> DataFrame:
    """One row per document: key, stratum, counts, base_failed, each rule's metric and cutoff, kept."""
    metrics = materialize(quality_metrics(docs.select(key, text, stratum), text).drop(text), "metrics")
    cuts = materialize(thresholds(metrics, labels, key, stratum, grid=grid, **risk), "thresholds")
    return with_verdict(metrics, cuts, stratum, grid)


def filter_kept(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **risk: float
) -> DataFrame:
    """The rows of ``docs`` that are kept, whole and unchanged.

    The metrics are computed once for the thresholds and once for the verdict, so texts are never shuffled.
    """
    own = docs.select(F.col(key).alias("__key"), F.col(stratum).alias("__stratum_of"), F.col(text).alias("__body"))
    held = materialize(quality_metrics(own, "__body").drop("__body"), "metrics")
    cuts = materialize(thresholds(held, labels.withColumnRenamed(key, "__key"), "__key", "__stratum_of", **risk), "thresholds")
    row = docs.select(F.struct(*map(F.col, docs.columns)).alias("__row"), F.col(stratum).alias("__stratum_of"), F.col(text).alias("__body"))
    judged = with_verdict(quality_metrics(row, "__body"), cuts, "__stratum_of")
    # as a generator: a filter would be pushed below the steps above, which then run again for every element
    return judged.select(F.explode(F.when(F.col("kept"), F.array("__row"))).alias("__row")).select("__row.*")
