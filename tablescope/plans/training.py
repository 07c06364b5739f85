"""From a table and a target to a trained, evaluated and summarised model."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope import schema as S
from tablescope.functions import analysis_id as new_analysis_id
from tablescope.operators import evaluate, models
from tablescope.operators.features import (
    MAX_CATEGORIES, FeaturePlan, assemble_features, fit_features, fit_plans, report_row,
    scaled_features, with_label,
)
from tablescope.operators.split import HASH_DIGITS, row_hash, stratified_split
from tablescope.operators.target import require_column
from tablescope.plans.insights import flat_runs, recommendation_codes
from tablescope.session import checkpointed
from tablescope.sources.results import conform

TRAINERS = {
    "logistic_regression": models.train_logistic,
    "decision_tree": models.train_tree,
    "gradient_boosting": models.train_boosting,
}


MOST_CLASSES = 10_000  # scores of one row are an array of as many numbers
MATRIX_CLASSES = 200


@dataclass
class Prepared:
    frame: DataFrame  # features vector, label, split
    plan: FeaturePlan


def prepare(
    df: DataFrame,
    target: str,
    model_type: str,
    keys: list[str] | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    fit_on: str = "all",
) -> Prepared:
    """Encode, impute, scale (logistic only) and split; checkpointed, as training reads it often.

    ``keys`` identify a row for the split; without them the whole row does.  ``fit_on='train'``
    splits first and learns medians, codes and scaling from the training rows only.
    """
    return prepare_each(df, target, [model_type], keys, test_size, seed, fit_on)[model_type]


def prepare_each(
    df: DataFrame,
    target: str,
    model_types: list[str],
    keys: list[str] | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    fit_on: str = "all",
) -> dict[str, Prepared]:
    """``prepare`` for several families: statistics and split are made once, equal frames are one frame."""
    kinds = [(MAX_CATEGORIES[m], m == "logistic_regression") for m in model_types]
    require_column(df, target)
    # columns go by place, so no name of a table can meet one used here
    shown = {f"f{i}": c for i, c in enumerate(df.columns)}
    place = {c: n for n, c in shown.items()}
    rows = df.toDF(*shown)
    own_target = place[target]
    cells = [F.coalesce(F.to_json(F.struct(F.col(place[k]).alias(k))), F.lit("")) for k in keys or df.columns]
    keyed = rows.withColumn("__row_key", F.md5(F.concat_ws("\u0001", *cells)))

    plans = fit_plans(rows, own_target, kinds, shown=shown)
    for plan in plans:
        if plan.n_classes > MOST_CLASSES:
            raise ValueError(f"target {target!r} has {plan.n_classes} classes, too many to train a classifier")
        if not plan.features:
            raise ValueError("no usable feature is left after the preparation")
    # the side is a column of the row itself: no join back, copies of a key stay what they are
    split = stratified_split(with_label(keyed, plans[0]), "__label", ["__row_key"], test_size, seed)
    if fit_on == "train":
        learned = fit_plans(split.where("split = 'train'").select(*shown), own_target, kinds, shown=shown)
        for own, plan in zip(learned, plans):
            own.labels, own.edges, own.label_codes = plan.labels, plan.edges, plan.label_codes
            own.n_classes, own.target_conversion = plan.n_classes, plan.target_conversion
            own.original_rows, own.rows_dropped = plan.original_rows, plan.rows_dropped
        plans = learned
    if len(plans) > 1:
        used = [c for c in shown if any(c in plan.features for plan in plans)]
        split = checkpointed(split.select("__label", "split", *used))
    frames: list[tuple[FeaturePlan, DataFrame]] = []
    for plan in plans:
        frame = next((f for p, f in frames if _same_features(p, plan)), None)
        if frame is None:
            frame = checkpointed(assemble_features(scaled_features(split, plan, ["__label", "split"]), plan).withColumnRenamed("__label", "label"))
        frames.append((plan, frame))
    return {m: Prepared(frame, plan.in_shown_names()) for m, (plan, frame) in zip(model_types, frames)}


def _same_features(a: FeaturePlan, b: FeaturePlan) -> bool:
    return (a.features, a.encoded, a.medians, a.scaling) == (b.features, b.encoded, b.medians, b.scaling)


def evaluation(scored: DataFrame, n_classes: int) -> dict:
    """All metrics of both sides as plain numbers (one or two rows per query).

    The matrix of all classes is laid out up to MATRIX_CLASSES; beyond, ``confusion_counts`` has its cells.
    """
    by = ["split"]
    # sparse: pairs of classes that occur, never all of them
    local = checkpointed(evaluate.confusion_counts(scored, by))
    result: dict = {}
    for r in evaluate.accuracy_of(local, by).collect():
        result[f"{r['split']}_accuracy"] = r["accuracy"]
    for r in evaluate.precision_recall_f1_of(local, n_classes, by).collect():
        for m in ("precision", "recall", "f1"):
            result[f"{r['split']}_{m}"] = r[m]
    test = scored.where(F.col("split") == "test")
    if n_classes == 2:
        curve = evaluate.roc_auc_binary(test.withColumn("score", F.col("scores")[1]))
    else:
        curve = evaluate.roc_auc_ovr(test, n_classes)
    result["test_roc_auc"] = curve.first()["roc_auc"]
    result["confusion_matrix"] = None
    if n_classes <= MATRIX_CLASSES:
        matrix = [[0] * n_classes for _ in range(n_classes)]
        for r in local.where("split = 'test'").collect():
            matrix[int(r["label"])][int(r["prediction"])] = r["n"]
        result["confusion_matrix"] = matrix
    return result


def _texts(summary: dict, top: list[tuple[str, float]]) -> dict:
    gap = summary["train_accuracy"] - summary["test_accuracy"]
    performance = (
        f"Test accuracy {summary['test_accuracy']:.1%}, precision {summary['test_precision']:.1%}, "
        f"recall {summary['test_recall']:.1%}, F1 {summary['test_f1_score']:.1%}."
    )
    if summary.get("tree_depth") is not None:
        performance += f" Depth {summary['tree_depth']}, {summary['n_leaves']} leaves."
    if gap > evaluate.OVERFIT_GAP:
        performance += f" Train accuracy is {gap:.1%} higher: over-fitting is likely."
    names = S.result_schema("workflow_model_summary")["preprocessing_details"].dataType.names
    details = dict(zip(names, summary["preprocessing_details"]))
    return {
        "performance_summary": performance,
        "top_features_summary": "; ".join(f"{i}. {f} ({v:.4f})" for i, (f, v) in enumerate(top, 1)),
        "data_quality_summary": (
            f"{details['original_rows']} rows, {details['final_features']} features kept, "
            f"{len(details['dropped_columns'])} columns dropped, "
            f"{details['missing_values_handled']} cells imputed, target: {details['target_conversion']}."
        ),
        "model_config_summary": summary["model_parameters"],
    }


@dataclass
class TrainingRun:
    summary: DataFrame  # one row of MODEL_SUMMARY
    importance: DataFrame
    scored: DataFrame
    trained: models.TrainedModel


def train_and_evaluate(
    df: DataFrame,
    target: str,
    model_type: str,
    table_name: str = "",
    workflow_id: str = "",
    problem_type: str | None = None,
    keys: list[str] | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    prepared: Prepared | None = None,
    **parameters,
) -> TrainingRun:
    spark = df.sparkSession
    prepared = prepared or prepare(df, target, model_type, keys, test_size, seed)
    plan = prepared.plan
    trained = TRAINERS[model_type](prepared.frame, plan.features, plan.n_classes, **parameters)
    scored = models.score(trained, prepared.frame)
    importance = models.feature_importance(trained, prepared.frame)
    metrics = evaluation(scored, plan.n_classes)
    ranked = [(r["feature"], r["importance"]) for r in importance.orderBy(F.desc("importance"), "feature").collect()]
    summary = {
        "analysis_id": spark.range(1).select(new_analysis_id("RUN")).first()[0],
        "workflow_id": workflow_id,
        "table_name": table_name,
        "target_variable": target,
        "model_type": model_type,
        "problem_type": problem_type,
        "test_f1_score": metrics["test_f1"],
        "train_f1_score": metrics["train_f1"],
        **{k: v for k, v in metrics.items() if not k.endswith("_f1")},
        "total_samples": plan.final_rows,
        "total_features": len(plan.features),
        "n_classes": plan.n_classes,
        "class_labels": plan.labels,
        "top_features": ranked[:5],
        "feature_importance": ranked,
        "preprocessing_details": report_row(plan),
        "model_parameters": json.dumps(trained.parameters, sort_keys=True),
    }
    if model_type == "decision_tree":
        summary.update(models.tree_structure(trained))
    schema = S.result_schema("workflow_model_summary")
    summary.update({k: v for k, v in trained.parameters.items() if k in schema.names})
    summary.update(_texts(summary, ranked[:5]))
    row = spark.createDataFrame([tuple(summary.get(n) for n in schema.names)], schema)
    row = row.withColumn("created_at", F.current_timestamp())
    codes = flat_runs(row).select("analysis_id", recommendation_codes().alias("codes"))
    row = row.drop("recommendations").join(codes, "analysis_id").withColumnRenamed("codes", "recommendations")
    return TrainingRun(conform(row, schema), importance, scored, trained)


def fold_of(keys: list[str], folds: int, seed: int = 42) -> Column:
    """Fold 0..folds-1 of a row by the hash of its key; copies of a key share a fold."""
    return F.floor(row_hash(keys, seed) * folds / 16**HASH_DIGITS).cast("int")


@dataclass
class OutOfFold:
    scored: DataFrame  # fold, label, prediction, scores: every usable row once, by a model that did not see it
    metrics: DataFrame  # one row per fold
    models: list[models.TrainedModel]


def cross_validate(
    df: DataFrame,
    target: str,
    model_type: str,
    keys: list[str] | None = None,
    folds: int = 5,
    seed: int = 42,
    keep: list[str] | None = None,
    **parameters,
) -> OutOfFold:
    """Train ``folds`` times, each time without one fold, and score that fold.

    Labels are coded once over all rows; which columns are used, codes, medians and scaling are learnt
    anew from the other folds, so nothing of a fold is known to the model that scores it.  A fold without
    rows is skipped.  ``keep`` names columns that the scored frame carries along.
    """
    if folds < 2:
        raise ValueError("at least two folds are needed")
    require_column(df, target)
    shown = {f"f{i}": c for i, c in enumerate(df.columns)}
    place = {c: n for n, c in shown.items()}
    kept = {c: f"__keep{i}" for i, c in enumerate(keep or [])}
    rows = df.toDF(*shown)
    rows = rows.withColumns({"__fold": fold_of([place[k] for k in keys or df.columns], folds, seed), **{n: F.col(place[c]) for c, n in kept.items()}})
    whole = fit_features(rows.select(*shown), place[target], MAX_CATEGORIES[model_type], shown=shown)
    labelled = checkpointed(with_label(rows, whole))
    parts, trained = [], []
    for fold in sorted(r["__fold"] for r in labelled.select("__fold").distinct().collect()):  # at most ``folds`` numbers
        side = F.when(F.col("__fold") == fold, "test").otherwise("train")
        learned = fit_features(labelled.where(F.col("__fold") != fold).select(*shown), place[target], MAX_CATEGORIES[model_type], model_type == "logistic_regression", shown=shown)
        if not learned.features:
            raise ValueError("no usable feature is left after the preparation")
        own = ["__fold", "__label", "split", *kept.values()]
        frame = assemble_features(scaled_features(labelled.withColumn("split", side), learned, own), learned).withColumnRenamed("__label", "label")
        frame = checkpointed(frame)
        model = TRAINERS[model_type](frame, [shown[c] for c in learned.features], whole.n_classes, **parameters)
        trained.append(model)
        scored = models.score(model, frame.where("split = 'test'"))
        parts.append(scored.select(F.col("__fold").alias("fold"), "label", "prediction", "scores", *[F.col(n).alias(c) for c, n in kept.items()]))
    if not parts:
        raise ValueError("there are no rows to train on")
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    scored = checkpointed(scored)
    counts = evaluate.confusion_counts(scored, ["fold"])
    metrics = evaluate.accuracy_of(counts, ["fold"]).join(evaluate.precision_recall_f1_of(counts, whole.n_classes, ["fold"]), "fold")
    return OutOfFold(scored, metrics.join(scored.groupBy("fold").agg(F.count(F.lit(1)).alias("rows")), "fold"), trained)
