"""Table-level metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import schema as S
from tablescope.functions import display, finite, percentage, round_half_up, safe_divide
from tablescope.operators.frequency import unique_stats
from tablescope.operators.numeric import long_form


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def describe_table(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, data_type, family) of each column."""
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(S.family(f.dataType)).alias("family"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*entries)))


def preview(df: DataFrame, order_by: list[str], rows: int = 5) -> DataFrame:
    """The first rows in a stated order (a per-task top-k, no full sort)."""
    return df.orderBy(*[S.quoted(c) for c in order_by]).limit(rows)


def sample_rows(df: DataFrame, rows: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """``rows`` rows, the first ones in ``order_by`` when given, else any."""
    return preview(df, order_by, rows) if order_by else df.limit(rows)


def null_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count and % of all rows for every column, of any type."""
    names = columns or df.columns
    total = F.count(F.lit(1))
    exprs = []
    for i, n in enumerate(names):
        nulls = total - F.count(S.quoted(n))
        exprs += [
            total.alias(f"total_count_{i}"),
            nulls.alias(f"null_count_{i}"),
            safe_divide(nulls * 100, total).alias(f"null_percentage_{i}"),
        ]
    return long_form(df, df.agg(*exprs), names, ["total_count", "null_count", "null_percentage"])


def basic_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Name, type, row count, null % and distinct values of every column."""
    nulls = null_stats(df, columns)
    unique = unique_stats(df, columns).select("column_name", "unique_count", "cardinality_ratio")
    types = describe_table(df).select("column_name", "data_type")
    return (
        nulls.join(types, "column_name")
        .join(unique, "column_name", "left")
        .select(
            "column_name", "data_type", "total_count", "null_percentage", "unique_count", "cardinality_ratio"
        )
    )


def row_key(field: T.StructField) -> Column:
    """Hashable stand-in for a cell when whole rows are compared."""
    value = F.col(S.quoted(field.name))
    if S.is_supported(field.dataType) or isinstance(field.dataType, T.BinaryType):
        return value
    if isinstance(field.dataType, T.MapType):
        value = F.array_sort(F.map_entries(value))  # entry order is no part of a map's value
    return F.to_json(F.struct(value))


def row_digest(df: DataFrame) -> Column:
    """32 bytes that are equal for equal rows: cells in order, each told from null and from its neighbours."""
    cells = []
    for f in df.schema.fields:
        value = row_key(f)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(value == 0, F.lit(0.0)).otherwise(value)  # 0.0 and -0.0 are one value
        text = F.base64(value) if isinstance(f.dataType, T.BinaryType) else value.cast("string")
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(F.lit(""), *cells), 256))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows over all columns; a null equals a null here.

    Rows are grouped by a digest of 256 bits, so the shuffle carries 32 bytes a row however wide
    the table is; copies are combined before it.
    """
    copies = df.select(row_digest(df).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    totals = copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows")
    )
    duplicates = F.col("total_rows") - F.col("distinct_rows")
    return totals.select(
        "total_rows",
        duplicates.alias("duplicate_rows"),
        percentage(duplicates, F.col("total_rows")).alias("duplicate_percentage"),
    )


def table_summary(
    df: DataFrame, table_name: str, target: str | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """One row about the table; duplicates always look at all columns, excluded or not."""
    kept = [c for c in df.columns if c not in (exclude or [])]
    return duplicate_rows(df).select(
        F.lit(table_name).alias("table_name"),
        "total_rows",
        F.lit(len(kept)).alias("total_columns"),
        "duplicate_rows",
        "duplicate_percentage",
        F.lit(target).cast("string").alias("target_column"),
        F.lit("supervised" if target else "unsupervised").alias("analysis_type"),
    )


def exclude_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def metric_sets(df: DataFrame) -> DataFrame:
    """Which metric sets apply to each column: by type, plus categorical at <= 100 distinct."""
    unique = unique_stats(df).select("column_name", "unique_count")
    joined = describe_table(df).join(unique, "column_name", "left")
    few = F.col("unique_count") <= S.MAX_CATEGORICAL_CARDINALITY
    return joined.select(
        "column_name",
        "family",
        "unique_count",
        (F.col("family") == "numeric").alias("numeric"),
        (F.col("family").isin("text", "categorical") | F.coalesce(few, F.lit(False))).alias("categorical"),
        (F.col("family") == "datetime").alias("datetime"),
        (F.col("family") == "text").alias("text"),
    )


def candidate_profile(df: DataFrame, order_by: list[str], sample: int = 100, values: int = 5) -> DataFrame:
    """Target-candidate facts per column: nulls, distinct values, range, and sample values.

    Counts and moments cover the whole table; the sample values are the first non-null ones
    of the first ``sample`` rows in ``order_by`` (a per-task top-k of a fixed size).
    """
    names = [f.name for f in df.schema.fields if S.is_supported(f.dataType)]
    exprs = []
    total = F.count(F.lit(1))
    for i, n in enumerate(names):
        numeric = S.is_numeric(df.schema[n].dataType)
        x = finite(F.col(S.quoted(n))) if numeric else F.lit(None).cast("double")
        nulls = total - F.count(S.quoted(n))
        exprs += [
            nulls.alias(f"null_count_{i}"),
            percentage(nulls, total).alias(f"null_percentage_{i}"),
            F.min(x).alias(f"min_{i}"),
            F.max(x).alias(f"max_{i}"),
            round_half_up(F.avg(x), 4).alias(f"mean_{i}"),
            round_half_up(F.stddev_samp(x), 4).alias(f"std_{i}"),
        ]
    fields = ["null_count", "null_percentage", "min", "max", "mean", "std"]
    wide = long_form(df, df.agg(*exprs), names, fields)

    first = preview(df.select(*[S.quoted(c) for c in df.columns]), order_by, sample)
    numbered = first.withColumn(
        "__row", F.row_number().over(W.orderBy(*[S.quoted(c) for c in order_by]))
    )
    entries = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.col("__row").alias("row"),
            display(F.col(S.quoted(n)), df.schema[n].dataType).alias("value"),
        )
        for n in names
    ]
    samples = (
        numbered.select(F.inline(F.array(*entries)))
        .where(F.col("value").isNotNull())
        .groupBy("column_name")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("row", "value"))), 1, values).alias("s"))
        .select("column_name", F.array_join(F.col("s.value"), ", ").alias("sample_values"))
    )
    unique = unique_stats(df).select("column_name", F.col("unique_count").alias("distinct_count"))
    return (
        describe_table(df)
        .select("ordinal", "column_name", "data_type")
        .join(wide, "column_name")
        .join(unique, "column_name")
        .join(samples, "column_name", "left")
    )
