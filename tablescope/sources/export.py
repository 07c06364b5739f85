"""Export of analysis results.  Results are small, the writers are Spark's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def results_document(summary: DataFrame, stats: DataFrame) -> DataFrame:
    """One nested record per analysis: its summary and the list of its column statistics."""
    columns = stats.groupBy("analysis_id").agg(
        F.array_sort(
            F.collect_list(F.struct("column_name", *[c for c in stats.columns if c not in ("analysis_id", "column_name")]))
        ).alias("column_statistics")
    )
    head = summary.select("analysis_id", F.struct(*summary.columns).alias("summary"))
    return head.join(columns, "analysis_id", "left").select("summary", "column_statistics")


def export_results(summary: DataFrame, stats: DataFrame, path: str, format: str = "json") -> str:
    if format == "json":
        results_document(summary, stats).write.mode("overwrite").json(path)
    elif format == "csv":
        stats.orderBy("column_name").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported export format {format!r}")
    return path
