"""The whole path: load, profile, choose a target, train three models, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.operators.association import target_quality_rank
from tablescope.operators.target import infer_problem_type, target_candidates
from tablescope.plans.insights import MODEL_ORDER, report_document
from tablescope.plans.profile import profile_table
from tablescope.plans.training import prepare_each, train_and_evaluate
from tablescope.sources import results
from tablescope.sources.csv import csv_ingest, normalize_table_name
from tablescope.sources.workspace import create_workflow, table_scan, workflow_namespace


def upload(spark: SparkSession, path: str, workflow_id: str | None = None) -> dict:
    """Load a CSV into a new workflow, profile it and rank its prediction targets."""
    workflow_id = create_workflow(spark, workflow_id)
    namespace = workflow_namespace(workflow_id)
    table = normalize_table_name(path)
    report = csv_ingest(spark, path, f"{namespace}.{table}")
    df = table_scan(spark, namespace, table)
    profile_and_store(df, namespace, table)
    return {"workflow_id": workflow_id, "table_name": table, "load": report, "targets": suggest_targets(df)}


def profile_and_store(df: DataFrame, namespace: str, table: str, target: str | None = None, exclude: list[str] | None = None) -> str:
    profile = profile_table(df, table, namespace, target, exclude)
    results.save_summary(profile.summary, namespace)
    results.save_column_stats(profile.column_stats, namespace)
    if profile.target_stats is not None:
        results.append_results(profile.target_stats, namespace, "workflow_target_stats")
    if profile.target_classes is not None:
        results.append_results(profile.target_classes, namespace, "workflow_target_classes")
    return profile.analysis_id


def suggest_targets(df: DataFrame) -> DataFrame:
    """Ranked targets; by position when no column qualifies for the quality ranking."""
    ranked = target_quality_rank(df)
    if ranked.isEmpty():
        return target_candidates(df)
    return ranked


def train_all(
    spark: SparkSession,
    workflow_id: str,
    table: str,
    target: str,
    keys: list[str] | None = None,
    model_parameters: dict[str, dict] | None = None,
) -> DataFrame:
    """Record the target, train the three families and store their summaries.

    Families share one preparation, except those whose parameters ask for a split of their own.
    """
    namespace = workflow_namespace(workflow_id)
    df = table_scan(spark, namespace, table)
    kind = infer_problem_type(df, [target]).first()["problem_type"]
    results.select_target(spark, namespace, table, target, kind)
    parameters = {m: (model_parameters or {}).get(m, {}) for m in MODEL_ORDER}
    alike = [m for m in MODEL_ORDER if not {"test_size", "seed", "prepared"} & parameters[m].keys()]
    shared = prepare_each(df, target, alike, keys) if alike else {}
    for model_type in MODEL_ORDER:
        own = {"prepared": shared[model_type]} if model_type in shared else {}
        run = train_and_evaluate(df, target, model_type, table, workflow_id, kind, keys, **own, **parameters[model_type])
        results.save_model_summary(run.summary, namespace)
    return spark.table(f"{namespace}.workflow_model_summary")


def report(spark: SparkSession, workflow_id: str, table: str) -> DataFrame:
    namespace = workflow_namespace(workflow_id)
    return report_document(
        table,
        workflow_id,
        spark.table(f"{namespace}.workflow_eda_summary"),
        spark.table(f"{namespace}.workflow_eda_column_stats"),
        spark.table(f"{namespace}.workflow_model_summary"),
    )
