"""The complete profile of a table in a fixed number of jobs, however many columns it has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import schema as S
from tablescope.functions import analysis_id as new_analysis_id
from tablescope.functions import pearson_skew, round_half_up, safe_divide
from tablescope.operators.frequency import frequency_summary, supported_columns
from tablescope.operators.numeric import numeric_columns, outlier_percentages, wide_stats
from tablescope.operators.tables import describe_table, null_stats, table_summary
from tablescope.operators.target import class_distribution, require_column, supervised_profile

_STATS_DDL = (
    "column_name string, mean double, std double, min_value string, max_value string, "
    "q1 double, median double, q3 double"
)


def column_profile(df: DataFrame, columns: list[str] | None = None, exact_outliers: bool = False) -> DataFrame:
    """One row per column with the statistics that suit its type.

    Numbers get moments, quartiles, outliers, skew and mode; text, booleans and every column
    with at most 100 distinct values get mode and entropy; nested columns get null shares only.
    """
    names = columns if columns is not None else df.columns
    types = describe_table(df).where(F.col("column_name").isin(*names)).select("column_name", "data_type", "family")
    supported = supported_columns(df, names)
    other = [n for n in names if n not in supported]
    parts = []
    if supported:
        filled = safe_divide((F.col("total_count") - F.col("filled_count")) * 100, F.col("total_count"))
        parts.append(
            frequency_summary(df, supported).select(
                "column_name",
                "total_count",
                filled.alias("null_percentage"),
                "unique_count",
                "mode_value",
                "entropy",
            )
        )
    if other:
        nothing = F.lit(None)
        parts.append(
            null_stats(df, other).select(
                "column_name", "total_count", "null_percentage",
                nothing.cast("bigint").alias("unique_count"),
                nothing.cast("string").alias("mode_value"),
                nothing.cast("double").alias("entropy"),
            )
        )
    basics = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    joined = types.join(basics, "column_name")

    numeric = numeric_columns(df, names)
    if numeric:
        stats = wide_stats(df, numeric)
        rows = [
            (n, s["mean"], s["std"], s["min"], s["max"], *(s["quantiles"] or [None] * 3)) for n, s in stats.items()
        ]
        values = df.sparkSession.createDataFrame(rows, _STATS_DDL)  # one row per column
        fences = outlier_percentages(df, {n: stats[n]["quantiles"] for n in numeric}, exact_outliers)
        joined = joined.join(F.broadcast(values), "column_name", "left").join(F.broadcast(fences), "column_name", "left")
    else:
        for f in T.StructType.fromDDL(_STATS_DDL + ", outlier_percentage double").fields[1:]:
            joined = joined.withColumn(f.name, F.lit(None).cast(f.dataType))

    few = F.coalesce(F.col("unique_count") <= S.MAX_CATEGORICAL_CARDINALITY, F.lit(False))
    categorical = F.col("family").isin("text", "categorical") | few
    mean, median, std = (round_half_up(F.col(c)) for c in ("mean", "median", "std"))
    return joined.select(
        "column_name",
        "data_type",
        "total_count",
        "null_percentage",
        "unique_count",
        F.when(F.col("unique_count").isNotNull(), safe_divide(F.col("unique_count"), F.col("total_count"))).alias("cardinality_ratio"),
        mean.alias("mean_value"),
        median.alias("median_value"),
        F.when(categorical | (F.col("family") == "numeric"), F.col("mode_value")).alias("mode_value"),
        std.alias("std_dev"),
        "min_value",
        "max_value",
        round_half_up(F.col("q1")).alias("q1"),
        round_half_up(F.col("q3")).alias("q3"),
        pearson_skew(mean, median, std).alias("skewness"),
        "outlier_percentage",
        F.when(categorical, F.col("entropy")).alias("entropy"),
    )


@dataclass
class Profile:
    analysis_id: str
    summary: DataFrame
    column_stats: DataFrame
    target_stats: DataFrame | None = None
    target_classes: DataFrame | None = None


def profile_table(
    df: DataFrame,
    table_name: str,
    schema_name: str | None = None,
    target: str | None = None,
    exclude: list[str] | None = None,
) -> Profile:
    """Summary, column statistics and, with a target, the supervised part."""
    if target is not None:
        require_column(df, target, exclude)
    identity = df.sparkSession.range(1).select(new_analysis_id()).first()[0]
    kept = [c for c in df.columns if c not in (exclude or [])]
    summary = table_summary(df, table_name, target, exclude).withColumns(
        {
            "analysis_id": F.lit(identity),
            "schema_name": F.lit(schema_name),
            "database_name": F.current_catalog(),
            "created_at": F.current_timestamp(),
        }
    )
    stats = column_profile(df, kept).select(F.lit(identity).alias("analysis_id"), "*")
    result = Profile(identity, summary, stats)
    if target is not None:
        result.target_stats = supervised_profile(df, target, identity, exclude)
        if result.target_stats.first()["problem_type"] != "regression":
            result.target_classes = class_distribution(df, target).select(
                F.lit(identity).alias("analysis_id"), F.lit(target).alias("target_column"), "*"
            )
    return result
