"""Target analysis: problem type, class balance, regression statistics, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope import schema as S
from tablescope.functions import (
    display, distribution_shape, pearson_skew, percentage, problem_type, round_half_up, safe_divide,
)
from tablescope.operators.frequency import unique_stats
from tablescope.operators.numeric import QUARTILES, wide_stats
from tablescope.operators.tables import describe_table

# Fixed values of the position-based suggestion.
LAST_COLUMNS = 5
SUGGESTED_FEATURES = 6


def require_column(df: DataFrame, name: str, excluded: list[str] | None = None) -> None:
    if name not in df.columns:
        raise ValueError(f"target column {name!r} is not in the table")
    if name in (excluded or []):
        raise ValueError(f"target column {name!r} is excluded from the analysis")


def infer_problem_type(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """What kind of prediction each column would be as a target."""
    families = describe_table(df).select("column_name", "family")
    joined = unique_stats(df, columns).join(families, "column_name")
    kind = problem_type(F.col("family") == "numeric", F.col("unique_count"))
    return joined.select("column_name", "unique_count", kind.alias("problem_type"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Class, count and % of all rows (nulls are no class but count as rows)."""
    require_column(df, target)
    total = F.lit(df.count())
    label = F.col(S.quoted(target))
    counted = df.where(label.isNotNull()).groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        display(F.col("class"), df.schema[target].dataType).alias("class"),
        "count",
        percentage(F.col("count"), total).alias("percentage"),
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Number of classes, majority and minority %, smallest / largest class."""
    require_column(df, target)
    label = F.col(S.quoted(target))
    counted = df.groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("class").isNotNull(), F.col("n"))
    sums = counted.agg(
        F.count(n).alias("num_classes"), F.max(n).alias("most"), F.min(n).alias("least"), F.sum("n").alias("total")
    )
    has_classes = F.col("num_classes") > 0
    return sums.select(
        "num_classes",
        F.when(has_classes, percentage(F.col("most"), F.col("total"))).alias("majority_class_percentage"),
        F.when(has_classes, percentage(F.col("least"), F.col("total"))).alias("minority_class_percentage"),
        F.when(has_classes, round_half_up(safe_divide(F.col("least"), F.col("most")))).alias("balance_ratio"),
    )


def regression_target_stats(df: DataFrame, target: str) -> DataFrame:
    """One row: mean, std, range, quartiles, skew and its verbal shape."""
    require_column(df, target)
    stats = wide_stats(df, [target], QUARTILES)[target]
    q1, median, q3 = stats["quantiles"] or [None] * 3
    row = (stats["mean"], stats["std"], stats["min"], stats["max"], q1, median, q3)
    frame = df.sparkSession.createDataFrame(
        [row], "mean double, std_dev double, min string, max string, q1 double, median double, q3 double"
    )
    names = ["mean", "std_dev", "min", "max", "q1", "median", "q3"]
    rounded = frame.select(*[round_half_up(F.col(c)).alias(c) for c in names])
    skew = pearson_skew(F.col("mean"), F.col("median"), F.col("std_dev"))
    return rounded.withColumn("skewness", skew).withColumn("distribution_shape", distribution_shape(F.col("skewness")))


def supervised_profile(
    df: DataFrame, target: str, analysis_id: str = "", excluded: list[str] | None = None
) -> DataFrame:
    """The target's problem type with its class balance or its regression statistics (one row)."""
    require_column(df, target, excluded)
    kind = infer_problem_type(df, [target]).first()["problem_type"]
    stats = regression_target_stats(df, target) if kind == "regression" else class_balance(df, target)
    head = stats.select(
        F.lit(analysis_id).alias("analysis_id"),
        F.lit(target).alias("target_column"),
        F.lit(kind).alias("problem_type"),
        "*",
    )
    fields = S.result_schema("workflow_target_stats").fields
    absent = [f for f in fields if f.name not in head.columns]
    for field in absent:
        head = head.withColumn(field.name, F.lit(None).cast(field.dataType))
    return head.select(*[f.name for f in fields])


def target_candidates(df: DataFrame) -> DataFrame:
    """Suggest numeric, non-constant columns among the last five, the last one first.

    The score drops by five per position, counted before unsuitable columns are left out.
    """
    last = df.columns[-LAST_COLUMNS:][::-1]
    entries = []
    for i, name in enumerate(last, 1):
        if not S.is_numeric(df.schema[name].dataType):
            continue
        features = [c for c in df.columns if c != name][:SUGGESTED_FEATURES]
        entries.append(
            F.struct(
                F.lit(i).alias("rank"),
                F.lit(name).alias("column_name"),
                F.lit(100 - 5 * i).alias("importance_score"),
                F.array(*[F.lit(c) for c in features]).alias("suggested_features"),
            )
        )
    numeric = [n for n in last if S.is_numeric(df.schema[n].dataType)]
    if not numeric:
        ddl = (
            "rank int, column_name string, importance_score int, problem_type string, "
            "distinct_count bigint, suggested_features array<string>"
        )
        return df.sparkSession.createDataFrame([], ddl)
    listed = df.sparkSession.range(1).select(F.inline(F.array(*entries)))
    unique = unique_stats(df, numeric).select("column_name", F.col("unique_count").alias("distinct_count"))
    kind = (
        F.when(F.col("distinct_count") == 2, "binary classification")
        .when(F.col("distinct_count") <= 10, "multi-class classification")
        .otherwise("regression")
    )
    return (
        listed.join(unique, "column_name")
        .where(F.col("distinct_count") > 1)
        .select("rank", "column_name", "importance_score", kind.alias("problem_type"), "distinct_count", "suggested_features")
    )
