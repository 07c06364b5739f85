"""Column expressions shared by the operators.  All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text patterns, tried in this order, first match wins.
TEXT_PATTERNS = {
    "email": r"^[\w\.-]+@[\w\.-]+\.\w+$",
    "phone": r"^[\+\d]?[\d\s\-\(\)]{7,}$",
    "url": r"^https?://[^\s]+$",
    "numeric": r"^\d+$",
    "alphanumeric": r"^[a-zA-Z0-9]+$",
}

# Of longer strings this much and a digest is the grouping key, so that shuffles don't carry the text.
# Keys sort like the strings themselves, but for long ones that begin alike, which go by digest.
LONG_TEXT = 256


def finite(value: Column) -> Column:
    """``value`` as a double, with NaN and the infinities turned into null."""
    number = value.cast("double")
    bad = F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(~bad, number)


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Round a finite number half up; null for null, NaN and the infinities."""
    return F.round(finite(value), digits)


def safe_divide(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Quotient as a double, or ``default`` when it is undefined."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(finite(quotient), F.lit(float(default)))


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_half_up(safe_divide(part * 100, whole), digits)


def display(value: Column, data_type: T.DataType) -> Column:
    """Text form of a value for result tables; whole doubles print without a fraction."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def compact_text(value: Column) -> Column:
    """Grouping key of a string: the string itself, or its beginning and a digest when it is long.

    Only keys of long strings are longer than LONG_TEXT.
    """
    digest = F.concat(F.substring(value, 1, LONG_TEXT), F.sha2(value, 256))
    return F.when(F.length(value) > LONG_TEXT, digest).otherwise(value)


def truncated(value: Column, limit: int = 1000) -> Column:
    """Cut at ``limit`` characters and mark the cut; null becomes the empty string."""
    cut = F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("...")))
    return F.coalesce(cut, value, F.lit(""))


def stripped(value: Column) -> Column:
    """Remove Unicode white space on both sides (``trim`` only knows the space)."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def text_pattern(value: Column) -> Column:
    """Name of the first pattern matching the stripped value, else null."""
    text = stripped(value)
    result = F.when(text == "", F.lit(None).cast("string"))
    for name, pattern in TEXT_PATTERNS.items():
        result = result.when(text.rlike("(?U)" + pattern), F.lit(name))
    return result


def weekday(value: Column) -> Column:
    """Day of the week with Sunday = 0."""
    return F.dayofweek(value) - 1


def pearson_skew(mean: Column, median: Column, std: Column) -> Column:
    """3 * (mean - median) / std for a positive std, two decimals."""
    return F.when(std > 0, round_half_up(safe_divide(3 * (mean - median), std)))


def distribution_shape(skew: Column) -> Column:
    return (
        F.when(skew.isNull(), "unknown")
        .when(F.abs(skew) < 0.5, "approximately_normal")
        .when(skew > 1, "right_skewed")
        .when(skew > 0, "moderately_right_skewed")
        .when(skew < -1, "left_skewed")
        .otherwise("moderately_left_skewed")
    )


def problem_type(numeric: Column, distinct: Column) -> Column:
    """Regression for numeric targets with more than 20 values, else by class count."""
    return (
        F.when(numeric & (distinct > 20), "regression")
        .when(distinct == 2, "binary_classification")
        .otherwise("multiclass_classification")
    )


def analysis_id(prefix: str = "EDA") -> Column:
    """A sortable, collision-free analysis id."""
    stamp = F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss_SSSSSS")
    return F.concat_ws("_", F.lit(prefix), stamp, F.substring(F.uuid(), 1, 8))


def json_value(value: Column) -> Column:
    """Result value of any type as JSON text (null stays null)."""
    text = F.to_json(F.struct(value.alias("v")))
    return F.get_json_object(text, "$.v")
