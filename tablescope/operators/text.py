"""Text column metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions import TEXT_PATTERNS, percentage, round_half_up, text_pattern, truncated
from tablescope.operators.numeric import long_form
from tablescope.schema import columns_of, is_text, quoted


def text_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return columns if columns is not None else columns_of(df, is_text)


def text_length(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = text_columns(df, columns)
    exprs = []
    for i, n in enumerate(names):
        size = F.length(quoted(n))
        exprs += [
            round_half_up(F.avg(size)).alias(f"avg_length_{i}"),
            F.min(size).alias(f"min_length_{i}"),
            F.max(size).alias(f"max_length_{i}"),
        ]
    return long_form(df, df.agg(*exprs), names, ["avg_length", "min_length", "max_length"])


def empty_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values that are blank after trimming, with their % of all rows."""
    names = text_columns(df, columns)
    exprs = []
    for i, n in enumerate(names):
        blank = F.count_if(F.length(F.trim(quoted(n))) == 0)
        exprs += [
            blank.alias(f"empty_string_count_{i}"),
            percentage(blank, F.count(F.lit(1))).alias(f"empty_string_percentage_{i}"),
        ]
    return long_form(df, df.agg(*exprs), names, ["empty_string_count", "empty_string_percentage"])


def pattern_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How many values of each column match each pattern (first match wins)."""
    names = text_columns(df, columns)
    classed = df.select(*[text_pattern(F.col(quoted(n))).alias(f"p{i}") for i, n in enumerate(names)])
    exprs = [
        F.count_if(F.col(f"p{i}") == pattern).alias(f"{pattern}_{i}")
        for i in range(len(names))
        for pattern in TEXT_PATTERNS
    ]
    return long_form(df, classed.agg(*exprs), names, list(TEXT_PATTERNS))


def truncate_text(df: DataFrame, column: str, limit: int = 1000) -> DataFrame:
    return df.withColumn(column, truncated(F.col(quoted(column)), limit))
