"""Quality classifier by co-training of a content view and a metadata view.

Each document has two views: numbers about its text (content), and numbers about its language, source and
layout (page metadata). One logistic model per view is fitted on the labelled documents; in each round
each model labels the pool documents it is most sure of, and these labels are given to the other model.
At the end both models are calibrated on labelled documents kept apart (a logistic fit of the label on
the model's log odds), the calibrated log odds of the views are combined by a third fit, and the
combination scores every document.

Models are fitted on bounded samples (``most_labelled`` and ``most_pool``, chosen by a hash of the key);
features and scores cover all documents and are column expressions.

Defined results: a null text is the empty text; nulls in metadata are values of their own; of repeated
labels of one key the best counts; without labels of both classes every score is the (smoothed) share of
good labels; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.quality_rules import quality_metrics
from tablescope.llm.shared import materialize, text_of

#: Labelled documents and unlabelled pool documents that models are fitted on, at most (about).
MOST_LABELLED, MOST_POOL = 20_000, 20_000
ROUNDS = 3
#: Pseudo-labels need this confidence, count this much, and number at most this share of the pool per round and class.
CONFIDENCE, PSEUDO_WEIGHT, ROUND_SHARE = 0.95, 0.5, 0.1
#: Every CALIBRATION-th labelled document is kept for calibration.
CALIBRATION = 4
#: Buckets of hashed languages and sources.
LANG_BUCKETS, SOURCE_BUCKETS = 8, 32
RIDGE = 1.0
CONTENT = ["symbols_per_word", "exclamations_per_word", "upper_share", "dup_line_share", "repeat_word_share", "mean_word_chars", "short_share", "digit_share"]
LAYOUT = ["log_chars", "log_lines", "line_chars"]


def features(docs: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    """key, held bucket and all feature columns; content ones are c0.., metadata ones m0..."""
    own = docs.select(F.col(key).alias("key"), text_of(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    own = quality_metrics(own, "text")
    chars, lines = F.length("text"), F.size(F.split("text", "\n"))
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    own = own.withColumns(
        {
            "short_share": share(F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,2}(?![^\x20\x09-\x0D])")), F.col("n_words")),
            "digit_share": share(F.regexp_count("text", F.lit("[0-9]")), chars),
            "log_chars": F.log1p(chars),
            "log_lines": F.log1p(lines),
            "line_chars": F.log1p(chars / lines),
        }
    )
    bucket = lambda column, n: F.pmod(F.xxhash64(F.coalesce(F.col(column), F.lit("")), F.col(column).isNull()), F.lit(n))
    columns = {f"c{i}": F.col(c).cast("double") for i, c in enumerate(CONTENT)}
    meta = [F.col(c).cast("double") for c in LAYOUT]
    meta += [(bucket("lang", LANG_BUCKETS) == i).cast("double") for i in range(LANG_BUCKETS)]
    meta += [(bucket("source", SOURCE_BUCKETS) == i).cast("double") for i in range(SOURCE_BUCKETS)]
    columns |= {f"m{i}": c for i, c in enumerate(meta)}
    return own.select("key", *[c.alias(n) for n, c in columns.items()])


@dataclass
class Logistic:
    """A ridge logistic model over standardised columns."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = RIDGE) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale == 0] = 1.0
        z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(50):  # Newton steps, halved where the loss would grow
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (weight * (p - y)) + penalty * w
            hessian = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            size = np.abs(step).max()
            w = w - step * min(1.0, 5.0 / max(size, 1e-12))
            if size < 1e-8:
                break
        return Logistic(w, mean, scale)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]

    def column(self, names: list[Column]) -> Column:
        slopes = self.weights[1:] / self.scale
        total = F.lit(float(self.weights[0] - slopes @ self.mean))
        for slope, name in zip(slopes, names):
            total = total + F.lit(float(slope)) * name
        return total


def sure(log_odds: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The open pool rows a model is most sure are good, and are bad."""
    most, edge = max(1, int(len(log_odds) * ROUND_SHARE)), math.log(CONFIDENCE / (1 - CONFIDENCE))
    order = np.argsort(-log_odds, kind="stable")
    good = [i for i in order[: 4 * most] if open_[i] and log_odds[i] >= edge][:most]
    bad = [i for i in order[::-1][: 4 * most] if open_[i] and log_odds[i] <= -edge][:most]
    return np.array(good, int), np.array(bad, int)


def co_train(views: list[np.ndarray], y: np.ndarray, pools: list[np.ndarray], rounds: int = ROUNDS) -> list[Logistic]:
    """Models of the views after ``rounds`` rounds of exchanging confident pseudo-labels."""
    given = [np.full(len(pools[0]), np.nan) for _ in views]  # labels each view has got from the other
    models = [Logistic.fit(x, y) for x in views]
    for _ in range(rounds):
        if not len(pools[0]):
            break
        for teacher, pupil in ((0, 1), (1, 0)):
            good, bad = sure(models[teacher].log_odds(pools[teacher]), np.isnan(given[pupil]))
            given[pupil][good], given[pupil][bad] = 1.0, 0.0
        for v, x in enumerate(views):
            has = ~np.isnan(given[v])
            weight = np.concatenate([np.ones(len(y)), np.full(has.sum(), PSEUDO_WEIGHT)])
            models[v] = Logistic.fit(np.vstack([x, pools[v][has]]), np.concatenate([y, given[v][has]]), weight)
    return models


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    good: str = "quality",
    rounds: int = ROUNDS,
    most_labelled: int = MOST_LABELLED,
    most_pool: int = MOST_POOL,
) -> DataFrame:
    """One row per document: key, p_text and p_metadata (calibrated), score, kept (score of 0.5 or more)."""
    rows = materialize(features(docs, key, text, lang, source), "features")
    names = [[c for c in rows.columns if c[0] == view and c != "key"] for view in "cm"]
    known = labels.where(F.col(key).isNotNull() & F.col(good).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(good).cast("double").alias("y"))
    labelled = rows.join(known, "key")
    pool = rows.join(known, "key", "left_anti")

    def sample(df: DataFrame, most: int):
        share = most / max(1, df.count())
        draw = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))
        return df.where(draw).orderBy("key").limit(most).toPandas()

    taught = sample(labelled, most_labelled)
    y = (taught["y"].to_numpy() > 0).astype(float) if len(taught) else np.empty(0)
    if not 0 < y.sum() < len(y):
        constant = F.lit(float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5)
        return rows.select(F.col("key").alias(key), constant.alias("p_text"), constant.alias("p_metadata"), constant.alias("score"), F.lit(True).alias("kept"))
    drawn = sample(pool, most_pool)
    apart = np.arange(len(y)) % CALIBRATION == 0
    if not all(0 < y[part].sum() < part.sum() for part in (apart, ~apart)):
        apart = np.zeros(len(y), bool)  # too few labels of a class to keep any apart
    views = [taught[n].to_numpy(float) for n in names]
    models = co_train([x[~apart] for x in views], y[~apart], [drawn[n].to_numpy(float) for n in names], rounds)

    held = apart if apart.any() else ~apart
    odds = [m.log_odds(x[held])[:, None] for m, x in zip(models, views)]
    calibrated = [Logistic.fit(o, y[held]) for o in odds]
    both = np.hstack([c.log_odds(o)[:, None] for c, o in zip(calibrated, odds)])
    combined = Logistic.fit(both, y[held])
    columns = [c.column([m.column([F.col(n) for n in own])]) for c, m, own in zip(calibrated, models, names)]
    rows = rows.withColumns({"__text": columns[0], "__metadata": columns[1]})
    rows = rows.withColumn("__score", combined.column([F.col("__text"), F.col("__metadata")]))
    chance = lambda c: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(c)))))
    return rows.select(F.col("key").alias(key), chance("__text").alias("p_text"), chance("__metadata").alias("p_metadata"), chance("__score").alias("score"), (F.col("__score") >= 0).alias("kept"))
