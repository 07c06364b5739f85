"""Rule-based insights and report data from the result tables.

Rules are columns: an array of ``when(condition, code)`` per row, nulls dropped.  Result tables
hold one row per run or per column, so everything here is small next to the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.operators.evaluate import OVERFIT_GAP, SEVERE_GAP
from tablescope.sources.results import newest_per

# Model families in the order that decides ties.
MODEL_ORDER = ["logistic_regression", "decision_tree", "gradient_boosting"]

# Wording of the rule codes.
MESSAGES = {
    "low_accuracy": "Test accuracy is under 70%: engineer better features or tune the model.",
    "overfitting": "Training accuracy is well above test accuracy: regularise, prune or add data.",
    "severe_overfitting": "The accuracy gap is above 15 points: stop earlier or simplify the model.",
    "deep_tree": "The tree has more than 20 levels: limit its depth.",
    "many_missing": "More cells were imputed than 10% of the rows: check how the data is collected.",
    "many_dropped": "More than 30% of the columns were dropped: revisit the preparation.",
    "excellent": "High accuracy with a small gap: the model generalises well.",
    "good": "No weakness found: the model can be considered for use.",
    "best_model": "This model has the highest test accuracy.",
    "strong_auc": "The ROC AUC is above 0.9, classes are ranked well.",
    "models_agree": "All models are within 5 points of accuracy.",
    "models_differ": "Model accuracy differs by 5 points or more.",
    "duplicates": "More than 5% of the rows are duplicates.",
    "sparse_columns": "Columns with more than 20% missing values.",
    "top_feature": "The strongest feature.",
    "improve_features": "Collect or derive more informative features.",
    "try_other_models": "Try a richer model family.",
    "plan_deployment": "Accuracy is above 95%: plan the roll-out.",
    "compare_live": "Compare against the present process on live data.",
    "reduce_overfitting": "Reduce over-fitting with regularisation or more rows.",
    "cross_validate": "Confirm the result with several splits.",
    "check_classes": "Look at each class separately: there are more than two.",
    "monitor": "Watch the model's quality over time.",
    "document": "Write down assumptions and limits.",
    "retrain": "Decide when the model is trained again.",
    "collect_data": "No model is available: collect more data and train again.",
}


def message(code: Column) -> Column:
    pairs = [F.lit(x) for item in MESSAGES.items() for x in item]
    return F.element_at(F.create_map(*pairs), code)


def _rules(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, code) for condition, code in rules]))


def family_place(model_type: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), model_type)


def recommendation_codes() -> Column:
    """Codes for one training run; needs the columns of ``model_recommendations``."""
    accuracy, train = F.col("test_accuracy"), F.col("train_accuracy")
    gap = train - accuracy
    is_tree = F.col("model_type") == "decision_tree"
    is_boosting = F.col("model_type") == "gradient_boosting"
    codes = _rules(
        (accuracy < 0.7, "low_accuracy"),
        (gap > OVERFIT_GAP, "overfitting"),
        (is_tree & (F.col("tree_depth") > 20), "deep_tree"),
        (is_boosting & (gap > SEVERE_GAP), "severe_overfitting"),
        (F.col("missing_values_handled") > F.col("original_rows") * 0.1, "many_missing"),
        (F.col("dropped_columns") > F.col("original_features") * 0.3, "many_dropped"),
        (is_boosting & (accuracy > 0.95) & (gap < 0.05), "excellent"),
    )
    return F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("good")))


def model_recommendations(runs: DataFrame) -> DataFrame:
    """(analysis_id, model_type, position, code, recommendation) for every run.

    ``runs`` has test_accuracy, train_accuracy, tree_depth, missing_values_handled,
    original_rows, dropped_columns (a count) and original_features.
    """
    return runs.select(
        "analysis_id", "model_type", F.posexplode(recommendation_codes()).alias("position", "code")
    ).withColumn("recommendation", message(F.col("code")))


def flat_runs(summary: DataFrame) -> DataFrame:
    """Bring the nested preparation counts of ``model_summary`` to the top level."""
    details = F.col("preprocessing_details")
    return summary.withColumns(
        {
            "missing_values_handled": details["missing_values_handled"],
            "original_rows": details["original_rows"],
            "original_features": details["original_features"],
            "dropped_columns": F.size(details["dropped_columns"]),
            "target_conversion": details["target_conversion"],
        }
    )


def latest_models(runs: DataFrame) -> DataFrame:
    """Newest run of each model family per table."""
    return newest_per(runs, ["table_name", "model_type"])


def latest_profile(summaries: DataFrame, stats: DataFrame, table_name: str, limit: int = 20) -> DataFrame:
    """Columns of the newest analysis of a table: fewest nulls first, then most distinct values."""
    newest = newest_per(summaries.where(F.col("table_name") == table_name), ["table_name"])
    own = stats.join(F.broadcast(newest.select("analysis_id", "table_name")), "analysis_id")
    return own.orderBy("null_percentage", F.desc_nulls_last("unique_count"), "column_name").limit(limit)


def best_model(models: DataFrame) -> DataFrame:
    """Per table the model with the highest test accuracy; ties go by family order."""
    place = F.row_number().over(
        W.partitionBy("table_name").orderBy(
            F.desc_nulls_last("test_accuracy"), family_place(F.col("model_type"))
        )
    )
    return models.withColumn("__place", place).where("__place = 1").drop("__place")


def metric_text(value: Column) -> Column:
    """Four decimals, N/A for null and zero."""
    return F.when(value != 0, F.format_string("%.4f", value)).otherwise("N/A")


def metrics_comparison(models: DataFrame) -> DataFrame:
    names = {
        "accuracy": "test_accuracy", "precision": "test_precision", "recall": "test_recall",
        "f1_score": "test_f1_score", "roc_auc": "test_roc_auc",
    }
    return models.select("table_name", "model_type", *[metric_text(F.col(c)).alias(n) for n, c in names.items()])


def model_ranking(models: DataFrame) -> DataFrame:
    """Models of each table by accuracy."""
    place = F.row_number().over(
        W.partitionBy("table_name").orderBy(F.desc_nulls_last("test_accuracy"), family_place(F.col("model_type")))
    )
    return models.select("table_name", place.alias("place"), "model_type", "test_accuracy")


def data_quality(summaries: DataFrame, stats: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Duplicate share and number of columns above a null share, per analysis."""
    sparse = stats.groupBy("analysis_id").agg(F.count_if(F.col("null_percentage") > threshold).alias("sparse_columns"))
    return summaries.join(sparse, "analysis_id", "left").select(
        "analysis_id", "table_name", "duplicate_percentage", F.coalesce("sparse_columns", F.lit(0)).alias("sparse_columns")
    )


def key_findings(models: DataFrame, quality: DataFrame, features: DataFrame) -> DataFrame:
    """(table_name, position, code, subject, value) for every table with models or a profile.

    ``quality`` is ``data_quality`` with its 20% threshold, ``features`` the strongest feature
    of each table's first model (table_name, feature).
    """
    spread = models.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_models"), (F.max("test_accuracy") - F.min("test_accuracy")).alias("spread")
    )
    best = best_model(models).select("table_name", "model_type", "test_accuracy", "test_roc_auc")
    joined = (
        best.join(spread, "table_name", "full")
        .join(quality.select("table_name", "duplicate_percentage", "sparse_columns"), "table_name", "full")
        .join(features.select("table_name", "feature"), "table_name", "left")
    )

    def finding(condition: Column, code: str, subject: Column, value: Column) -> Column:
        entry = F.struct(F.lit(code).alias("code"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))
        return F.when(condition, entry)

    none = F.lit(None)
    has_best, several = F.col("model_type").isNotNull(), F.col("n_models") > 1
    entries = F.array(
        finding(has_best, "best_model", F.col("model_type"), F.col("test_accuracy")),
        finding(F.col("test_roc_auc") > 0.9, "strong_auc", F.col("model_type"), F.col("test_roc_auc")),
        finding(several & (F.col("spread") < 0.05), "models_agree", none, F.col("spread")),
        finding(several & (F.col("spread") >= 0.05), "models_differ", none, F.col("spread")),
        finding(F.col("duplicate_percentage") > 5, "duplicates", none, F.col("duplicate_percentage")),
        finding(F.col("sparse_columns") > 0, "sparse_columns", none, F.col("sparse_columns")),
        finding(F.col("feature").isNotNull(), "top_feature", F.col("feature"), none),
    )
    exploded = joined.select("table_name", F.posexplode(F.array_compact(entries)).alias("position", "f"))
    return exploded.select("table_name", "position", "f.code", "f.subject", "f.value", message(F.col("f.code")).alias("finding"))


def report_recommendations(best: DataFrame) -> DataFrame:
    """(table_name, position, code, recommendation) for the best model of each table."""
    accuracy = F.col("test_accuracy")
    gap = F.col("train_accuracy") - accuracy
    always = F.lit(True)
    codes = _rules(
        (accuracy < 0.7, "improve_features"),
        (accuracy < 0.7, "try_other_models"),
        (accuracy > 0.95, "plan_deployment"),
        (accuracy > 0.95, "compare_live"),
        (gap > OVERFIT_GAP, "reduce_overfitting"),
        (gap > OVERFIT_GAP, "cross_validate"),
        (F.col("n_classes") > 2, "check_classes"),
        (always, "monitor"),
        (always, "document"),
        (always, "retrain"),
    )
    return best.select("table_name", F.posexplode(codes).alias("position", "code")).withColumn(
        "recommendation", message(F.col("code"))
    )


def column_summary(columns: DataFrame, limit: int = 15) -> DataFrame:
    """Report view of the first columns of ``latest_profile``."""
    return columns.orderBy("null_percentage", F.desc_nulls_last("unique_count"), "column_name").limit(limit).select(
        "column_name",
        "data_type",
        F.format_string("%.2f%%", F.coalesce("null_percentage", F.lit(0.0))).alias("null_share"),
        "unique_count",
        F.when(F.col("mean_value").isNotNull(), F.format_string("%.4f", "mean_value")).otherwise("N/A").alias("mean"),
    )


def feature_ranking(importance: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    """Top features per model: rank and |importance| with six decimals."""
    size = F.abs(F.col("importance"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("importance"), "feature"))
    ranked = importance.withColumn("importance", size).withColumn("rank", place).where(F.col("rank") <= limit)
    return ranked.select(*keys, "rank", "feature", F.format_string("%.6f", "importance").alias("importance"))


def confusion_eligibility(runs: DataFrame) -> DataFrame:
    """Whether a confusion matrix makes sense: 2 to 20 classes and a target that was not binned."""
    conversion = F.lower(F.coalesce("target_conversion", F.lit("")))
    binned = conversion.contains("continuous_to") | conversion.contains("regression") | conversion.contains("binned")
    classes = F.coalesce(F.col("n_classes").between(2, 20), F.lit(False))
    return runs.select("analysis_id", "model_type", "n_classes", (classes & ~binned).alias("show_matrix"))


def insights_available(tables: DataFrame, summaries: DataFrame, runs: DataFrame) -> DataFrame:
    """For each table_name of ``tables``: is there a profile, how many model families, ready?"""
    profiled = summaries.select("table_name").distinct().withColumn("has_profile", F.lit(True))
    latest = latest_models(runs)
    models = latest.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("models_available"),
        F.array_sort(F.collect_list(F.struct("model_type", "test_accuracy"))).alias("models"),
    )
    joined = tables.join(profiled, "table_name", "left").join(models, "table_name", "left")
    has_profile = F.coalesce("has_profile", F.lit(False))
    count = F.coalesce("models_available", F.lit(0))
    return joined.select(
        "table_name",
        has_profile.alias("eda_available"),
        count.alias("models_available"),
        "models",
        (has_profile | (count > 0)).alias("ready_for_insights"),
    )


def _list(frame: DataFrame, order: list[str], fields: list[str], name: str) -> DataFrame:
    """A small frame as one array column, ordered by ``order``."""
    items = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return frame.agg(items.alias(name))


def report_document(
    table_name: str, workflow_id: str, summaries: DataFrame, stats: DataFrame, runs: DataFrame
) -> DataFrame:
    """One row with the five report sections of a table as nested JSON text."""
    summary = newest_per(summaries.where(F.col("table_name") == table_name), ["table_name"])
    columns = latest_profile(summaries, stats, table_name)
    models = latest_models(runs.where(F.col("table_name") == table_name))
    placed = models.withColumn("place", family_place(F.col("model_type")))
    first = placed.orderBy("place").limit(1)
    best = best_model(models)
    importance = models.select("model_type", F.inline("top_features"))
    strongest = first.select("table_name", F.get("top_features", F.lit(0))["feature"].alias("feature"))
    quality = data_quality(summary, stats, 20.0)

    shown = column_summary(columns).withColumn("place", F.monotonically_increasing_id())
    comparison = metrics_comparison(placed).withColumn("place", family_place(F.col("model_type")))
    matrices = placed.join(
        confusion_eligibility(flat_runs(placed)).where("show_matrix").select("analysis_id"), "analysis_id"
    )
    key = F.lit(table_name)
    parts = [
        _list(shown, ["place"], ["column_name", "data_type", "null_share", "unique_count", "mean"], "column_summary"),
        first.agg(F.first("preprocessing_details").alias("preprocessing")),
        _list(comparison, ["place"], ["model_type", "accuracy", "precision", "recall", "f1_score", "roc_auc"], "metrics"),
        _list(matrices, ["place"], ["model_type", "confusion_matrix"], "confusion_matrices"),
        best.agg(F.first(F.struct("model_type", "test_accuracy", "test_precision", "test_recall", "test_f1_score", "test_roc_auc")).alias("best_model")),
        _list(feature_ranking(importance, ["model_type"]), ["model_type", "rank"], ["feature", "importance"], "features"),
        _list(key_findings(models, quality, strongest), ["position"], ["code", "subject", "value", "finding"], "findings"),
        _list(report_recommendations(best), ["position"], ["code", "recommendation"], "recommendations"),
        summary.agg(F.first(F.struct("total_rows", "total_columns", "target_column", "duplicate_rows", "duplicate_percentage")).alias("statistics")),
    ]
    row = parts[0].withColumn("table_name", key)
    for part in parts[1:]:
        row = row.join(part.withColumn("table_name", key), "table_name")  # one row on each side
    return row.select(
        F.lit(workflow_id).alias("workflow_id"),
        "table_name",
        F.current_timestamp().alias("generated_at"),
        F.to_json(
            F.struct(
                F.struct("statistics", "column_summary").alias("dataset"),
                F.struct("preprocessing").alias("preprocessing"),
                F.struct("metrics", "best_model", "confusion_matrices").alias("performance"),
                F.struct("features").alias("explainability"),
                F.struct("findings", "recommendations").alias("conclusion"),
            )
        ).alias("report"),
    )
