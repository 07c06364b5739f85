"""Numeric column metrics: one wide aggregate, one bracket pass, one outlier pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import schema as S
from tablescope.functions import display, finite, pearson_skew, percentage, round_half_up
from tablescope.operators.quantiles import exact_quantiles, probe_points, sketch

QUARTILES = [0.25, 0.5, 0.75]
COLUMNS_PER_JOB = 50  # keeps the generated aggregate code of very wide tables compilable


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    chosen = columns if columns is not None else df.columns
    return [c for c in chosen if S.is_numeric(df.schema[c].dataType)]


def as_double(df: DataFrame, name: str) -> Column:
    """Column as a double; NaN and infinities of floating columns count as null."""
    value = F.col(S.quoted(name))
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return finite(value) if floating else value.cast("double")


def doubles(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns as doubles under x0, x1, ...: cleaned once, then used by many aggregates."""
    return df.select(*[as_double(df, n).alias(f"x{i}") for i, n in enumerate(names)])


def long_form(df: DataFrame, row: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """Turn a one-row wide aggregate with columns ``<field>_<i>`` into one row per column."""
    entries = [
        F.struct(F.lit(n).alias("column_name"), *[F.col(f"{f}_{i}").alias(f) for f in fields])
        for i, n in enumerate(names)
    ]
    return row.select(F.inline(F.array(*entries)))


def numeric_basic(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, sample std and variance (two decimals), min and max of each numeric column."""
    names = numeric_columns(df, columns)
    exprs = []
    for i in range(len(names)):
        x = F.col(f"x{i}")
        exprs += [
            round_half_up(F.avg(x)).alias(f"mean_value_{i}"),
            round_half_up(F.stddev_samp(x)).alias(f"std_dev_{i}"),
            round_half_up(F.var_samp(x)).alias(f"variance_{i}"),
            F.min(x).alias(f"min_value_{i}"),
            F.max(x).alias(f"max_value_{i}"),
        ]
    fields = ["mean_value", "std_dev", "variance", "min_value", "max_value"]
    return long_form(df, doubles(df, names).agg(*exprs), names, fields)


def numeric_kurtosis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Population excess kurtosis of each numeric column."""
    names = numeric_columns(df, columns)
    exprs = [round_half_up(F.kurtosis(f"x{i}"), 4).alias(f"kurtosis_{i}") for i in range(len(names))]
    return long_form(df, doubles(df, names).agg(*exprs), names, ["kurtosis"])


def wide_stats(df: DataFrame, columns: list[str], probs: list[float] = QUARTILES) -> dict:
    """Counts, moments and exact quantiles of numeric ``columns`` (a few numbers per column)."""
    points = probe_points(probs)
    stats: dict[str, dict] = {}
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        chunk = columns[start : start + COLUMNS_PER_JOB]
        base = df.select(
            *[as_double(df, n).alias(f"x{i}") for i, n in enumerate(chunk)],
            *[F.col(S.quoted(n)).alias(f"r{i}") for i, n in enumerate(chunk)],
        )
        exprs = []
        for i, n in enumerate(chunk):
            x, raw = F.col(f"x{i}"), F.col(f"r{i}")
            exprs += [
                F.count(x).alias(f"n{i}"),
                F.avg(x).alias(f"mean{i}"),
                F.stddev_samp(x).alias(f"std{i}"),
                display(F.min(raw), df.schema[n].dataType).alias(f"min{i}"),
                display(F.max(raw), df.schema[n].dataType).alias(f"max{i}"),
                sketch(x, points).alias(f"s{i}"),
            ]
        row = base.agg(*exprs).first()
        exact = exact_quantiles(
            base,
            {n: F.col(f"x{i}") for i, n in enumerate(chunk)},
            probs,
            counts={n: row[f"n{i}"] for i, n in enumerate(chunk)},
            sketches={n: (points, row[f"s{i}"]) for i, n in enumerate(chunk) if row[f"n{i}"]},
        )
        for i, n in enumerate(chunk):
            stats[n] = {
                "count": row[f"n{i}"],
                "mean": row[f"mean{i}"],
                "std": row[f"std{i}"],
                "min": row[f"min{i}"],
                "max": row[f"max{i}"],
                "quantiles": exact[n],
            }
    return stats


def approximate_quantiles(df: DataFrame, columns: list[str] | None = None, probs: list[float] = QUARTILES) -> DataFrame:
    """The opt-in for huge tables: quantiles within 1/10,000 of the rank, in one pass."""
    names = numeric_columns(df, columns)
    exprs = [sketch(F.col(f"x{i}"), probs).alias(f"quantiles_{i}") for i in range(len(names))]
    return long_form(df, doubles(df, names).agg(*exprs), names, ["quantiles"])


def _local(df: DataFrame, rows: list[tuple], ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, ddl)


def numeric_quartiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = numeric_columns(df, columns)
    exact = quantiles_of(df, names, QUARTILES)
    rows = [(n, *(exact[n] or [None] * 3)) for n in names]
    frame = _local(df, rows, "column_name string, q1 double, median_value double, q3 double")
    return frame.select("column_name", *[round_half_up(F.col(c)).alias(c) for c in ("q1", "median_value", "q3")])


def percentile_profile(
    df: DataFrame, columns: list[str] | None = None, percentiles: list[int] = S.PERCENTILES
) -> DataFrame:
    names = numeric_columns(df, columns)
    exact = quantiles_of(df, names, [p / 100 for p in percentiles])
    rows = [(n, *(exact[n] or [None] * len(percentiles))) for n in names]
    fields = [f"p{p}" for p in percentiles]
    frame = _local(df, rows, "column_name string, " + ", ".join(f"{f} double" for f in fields))
    return frame.select("column_name", *[round_half_up(F.col(f)).alias(f) for f in fields])


def outlier_bounds(q1: float, q3: float, exact: bool = False) -> tuple[Column, Column]:
    """IQR fences; from quartiles rounded to two decimals unless ``exact``."""
    low, high = F.lit(q1), F.lit(q3)
    if not exact:
        low, high = F.round(low, 2), F.round(high, 2)
    reach = (high - low) * S.IQR_MULTIPLIER
    return low - reach, high + reach


def outlier_percentages(
    df: DataFrame, quartiles: dict[str, list[float] | None], exact: bool = False
) -> DataFrame:
    """% of all rows outside the fences, all columns in one scan; null without quartiles."""
    names = list(quartiles)
    exprs = []
    for i, n in enumerate(names):
        if quartiles[n] is None:
            exprs.append(F.max(F.lit(None).cast("double")).alias(f"outlier_percentage_{i}"))
            continue
        low, high = outlier_bounds(quartiles[n][0], quartiles[n][2], exact)
        x = F.col(f"x{i}")
        share = percentage(F.count_if((x < low) | (x > high)), F.count(F.lit(1)))
        exprs.append(share.alias(f"outlier_percentage_{i}"))
    return long_form(df, doubles(df, names).agg(*exprs), names, ["outlier_percentage"])


def quantiles_of(df: DataFrame, names: list[str], probs: list[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of numeric columns by name."""
    columns = {n: F.col(f"x{i}") for i, n in enumerate(names)}
    return exact_quantiles(doubles(df, names), columns, probs)


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    names = numeric_columns(df, columns)
    quartiles = quantiles_of(df, names, QUARTILES)
    return outlier_percentages(df, quartiles, exact)


def pearson_skewness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = numeric_columns(df, columns)
    stats = wide_stats(df, names, [0.5])
    rows = [
        (n, stats[n]["mean"], (stats[n]["quantiles"] or [None])[0], stats[n]["std"]) for n in names
    ]
    frame = _local(df, rows, "column_name string, mean_value double, median_value double, std_dev double")
    rounded = frame.select(
        "column_name",
        *[round_half_up(F.col(c)).alias(c) for c in ("mean_value", "median_value", "std_dev")],
    )
    skew = pearson_skew(F.col("mean_value"), F.col("median_value"), F.col("std_dev"))
    return rounded.select("*", skew.alias("skewness"))
