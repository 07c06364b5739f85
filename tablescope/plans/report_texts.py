"""The sentences of a report: one row per table, section and sentence, for any number of tables at once.

Sections are dataset, preprocessing, performance, explainability, conclusion and next_steps. A sentence
whose figures are missing is left out, so a table without models has no performance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.operators.evaluate import OVERFIT_GAP
from tablescope.plans.insights import best_model, family_place, latest_models
from tablescope.sources.results import newest_per

NEXT_STEPS = {
    "deploy": "Put the best model to use.",
    "watch": "Compare its predictions with what really happens.",
    "combine": "Try whether several models together are more accurate.",
    "features": "Look for better features where importance is low.",
    "retrain": "Plan when the models are trained again.",
}
MEASURES = (
    "Importance is the mean size of the coefficients for logistic regression, the share of the Gini decrease "
    "for the tree, and the mean gain of a split for boosting."
)


def percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value * 100)


def _sentences(frame: DataFrame, section: str, sentences: list[tuple[str, Column]]) -> DataFrame:
    """(table_name, section, position, code, text) of the sentences that aren't null."""
    items = [F.struct(F.lit(i).alias("position"), F.lit(code).alias("code"), text.alias("text")) for i, (code, text) in enumerate(sentences)]
    rows = frame.select("table_name", F.lit(section).alias("section"), F.inline(F.array(*items)))
    return rows.where(F.col("text").isNotNull())


def section_texts(summaries: DataFrame, runs: DataFrame) -> DataFrame:
    """Sentences about every table that has an analysis or a model.

    ``runs`` are flat: with the counts of the preparation as columns (``flat_runs``).
    """
    newest = newest_per(summaries, ["table_name"])
    models = latest_models(runs)
    best = best_model(models)
    in_order = F.array_sort(F.collect_list(F.struct(family_place(F.col("model_type")).alias("place"), "model_type")))
    compared = models.groupBy("table_name").agg(in_order["model_type"].alias("names"))
    first = models.withColumn("place", family_place(F.col("model_type"))).groupBy("table_name").agg(
        F.min_by(F.struct("missing_values_handled", "dropped_columns", "target_conversion"), "place").alias("p")
    )
    rated = best.join(compared, "table_name")  # one row per table on each side
    gap = F.col("train_accuracy") - F.col("test_accuracy")
    duplicates = F.col("duplicate_percentage")
    parts = [
        _sentences(newest, "dataset", [
            ("size", F.format_string("Table %s has %d rows and %d columns.", "table_name", "total_rows", "total_columns")),
            ("target", F.when(F.col("target_column").isNotNull(), F.format_string("It is used to predict %s.", "target_column"))),
            ("duplicates", F.when(duplicates > 0, F.format_string("%.2f%% of its rows repeat another row.", duplicates))),
        ]),
        _sentences(first, "preprocessing", [
            ("imputed", F.format_string("%d missing cells were filled with the median of their column.", F.col("p.missing_values_handled"))),
            ("dropped", F.format_string("%d columns were left out: mostly empty, too many values, or of a kind that can't be used.", F.col("p.dropped_columns"))),
            ("target", F.format_string("The target was prepared as %s.", F.col("p.target_conversion"))),
            ("scaled", F.lit("Text columns became codes; features were scaled for logistic regression.")),
        ]),
        _sentences(rated, "performance", [
            ("models", F.format_string("%d models were compared: %s.", F.size("names"), F.array_join("names", ", "))),
            ("best", F.concat(F.col("model_type"), F.lit(" is the most accurate, with "), percent(F.col("test_accuracy")), F.lit(" of the test rows right."))),
            ("detail", F.concat(F.lit("Its precision is "), percent(F.col("test_precision")), F.lit(", its recall "), percent(F.col("test_recall")), F.lit(", its F1 score "), percent(F.col("test_f1_score")), F.lit("."))),
            ("order", F.when(F.col("test_roc_auc").isNotNull(), F.format_string("Its area under the ROC curve is %.4f.", "test_roc_auc"))),
        ]),
        _sentences(compared, "explainability", [("measures", F.lit(MEASURES))]),
        _sentences(best, "conclusion", [
            ("summary", F.concat(F.lit("The best model is "), F.col("model_type"), F.lit(" with an accuracy of "), percent(F.col("test_accuracy")), F.lit("."))),
            ("fit", F.when(gap > OVERFIT_GAP, "It fits the training rows much better than others, which should be mended first.").when(gap.isNotNull(), "It does about as well on rows it has not seen.")),
        ]),
        _sentences(best, "next_steps", [(code, F.lit(text)) for code, text in NEXT_STEPS.items()]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
