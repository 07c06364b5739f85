"""Classification metrics as aggregates over (label, prediction, score) rows.

``by`` names grouping columns such as split or model; all metrics of all groups come from the
same small confusion counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions import safe_divide
from tablescope.operators.ordering import totals_before

# Accuracy gaps that count as over-fitting.
OVERFIT_GAP = 0.10
SEVERE_GAP = 0.15


def confusion_counts(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per (group, label, prediction): at most groups * classes ** 2 rows."""
    return scored.groupBy(*(by or []), "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def accuracy(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return accuracy_of(confusion_counts(scored, by), by)


def accuracy_of(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy from confusion counts."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    return counts.groupBy(*(by or [])).agg((F.sum(hit) / F.sum("n")).alias("accuracy"))


def per_class(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Support, precision, recall and F1 of every class seen as label or prediction."""
    by = by or []
    hit = F.col("label") == F.col("prediction")
    actual = counts.groupBy(*by, F.col("label").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.lit(0).alias("predicted")
    )
    guessed = counts.groupBy(*by, F.col("prediction").alias("class")).agg(
        F.lit(0).alias("support"), F.lit(0).alias("tp"), F.sum("n").alias("predicted")
    )
    both = actual.unionByName(guessed).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted")
    )
    tp = F.col("tp")
    return both.select(
        *by,
        "class",
        "support",
        safe_divide(tp, F.col("predicted")).alias("precision"),
        safe_divide(tp, F.col("support")).alias("recall"),
        safe_divide(2 * tp, F.col("support") + F.col("predicted")).alias("f1"),
    )


def precision_recall_f1(scored: DataFrame, n_classes: int, by: list[str] | None = None) -> DataFrame:
    """Two classes: the metrics of class 1.  Otherwise weighted by support."""
    return precision_recall_f1_of(confusion_counts(scored, by), n_classes, by)


def precision_recall_f1_of(counts: DataFrame, n_classes: int, by: list[str] | None = None) -> DataFrame:
    by = by or []
    classes = per_class(counts, by)
    if n_classes == 2:
        is_positive = F.col("class") == 1
        exprs = [F.coalesce(F.max(F.when(is_positive, F.col(m))), F.lit(0.0)).alias(m) for m in ("precision", "recall", "f1")]
    else:
        exprs = [
            safe_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m)
            for m in ("precision", "recall", "f1")
        ]
    return classes.groupBy(*by).agg(*exprs)


def confusion_matrix(scored: DataFrame, n_classes: int) -> DataFrame:
    """(label, prediction, count) for all class codes 0..n_classes-1, zeros included."""
    spark = scored.sparkSession
    grid = spark.range(n_classes).select(
        F.col("id").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("prediction")
    )
    counts = confusion_counts(scored).select(
        F.col("label").cast("bigint").alias("label"), F.col("prediction").cast("int").alias("prediction"), "n"
    )
    return grid.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("count")
    )


def _auc_per_class(counted: DataFrame, groups: list[str]) -> DataFrame:
    """Tie-aware AUC from (groups, score, pos, neg) rows, one per distinct score."""
    ordered = totals_before(counted, ["score"], {"neg_below": F.col("neg")}, within=groups)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    sums = ordered.groupBy(*groups).agg(wins.alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    auc = F.col("wins").cast("double") / (F.col("pos").cast("double") * F.col("neg").cast("double"))
    return sums.select(*groups, "pos", "neg", F.when(both, auc).alias("auc"))


def roc_auc_binary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve of column ``score`` for label 1; null with one class only."""
    by = by or []
    positive = F.col("label") == 1
    counted = scored.groupBy(*by, "score").agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    return _auc_per_class(counted, by).select(*by, F.col("auc").alias("roc_auc"))


def roc_auc_ovr(scored: DataFrame, n_classes: int) -> DataFrame:
    """One-vs-rest AUC of the array column ``scores``, weighted by class frequency.

    Null when a class never occurs, as its curve is undefined.
    """
    long = scored.select("label", F.posexplode("scores").alias("class", "score"))
    positive = F.col("label") == F.col("class")
    counted = long.groupBy("class", "score").agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    classes = _auc_per_class(counted, ["class"])
    complete = (F.count("auc") == n_classes) & (F.count(F.lit(1)) == n_classes)
    weighted = F.sum(F.col("auc") * F.col("pos")) / F.sum("pos")
    return classes.agg(F.when(complete, weighted).alias("roc_auc"))


def class_labels(scored: DataFrame) -> DataFrame:
    """Distinct classes of the training rows."""
    return scored.where(F.col("split") == "train").select("label").distinct()


def overfit_gap(metrics: DataFrame) -> DataFrame:
    """Train minus test accuracy with the two warning levels."""
    gap = F.col("train_accuracy") - F.col("test_accuracy")
    return metrics.select(
        "*",
        gap.alias("accuracy_gap"),
        (gap > OVERFIT_GAP).alias("overfitting"),
        (gap > SEVERE_GAP).alias("severe_overfitting"),
    )


def top_features(importance: DataFrame, limit: int = 5) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(limit)
