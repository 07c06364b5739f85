"""Date and timestamp metrics.  Groups are years, months, weekdays or days, so bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.functions import weekday
from tablescope.schema import quoted


def date_range(df: DataFrame, column: str) -> DataFrame:
    low, high = F.min(quoted(column)), F.max(quoted(column))
    return df.agg(
        low.alias("min_date"), high.alias("max_date"), F.datediff(high, low).alias("date_range_days")
    )


def _busiest(df: DataFrame, column: str, part: Column, name: str, limit: int) -> DataFrame:
    counted = df.where(F.col(quoted(column)).isNotNull()).groupBy(part.alias(name)).count()
    return counted.orderBy(F.desc("count"), name).limit(limit)


def by_year(df: DataFrame, column: str, limit: int = 5) -> DataFrame:
    return _busiest(df, column, F.year(quoted(column)), "year", limit)


def by_month(df: DataFrame, column: str, limit: int = 5) -> DataFrame:
    return _busiest(df, column, F.month(quoted(column)), "month", limit)


def by_day_of_week(df: DataFrame, column: str) -> DataFrame:
    filled = df.where(F.col(quoted(column)).isNotNull())
    return filled.groupBy(weekday(F.col(quoted(column))).alias("day")).count().orderBy("day")


def largest_gap(df: DataFrame, column: str) -> DataFrame:
    """Largest gap in days between neighbouring values.

    Gaps count day boundaries, so the distinct days decide; two rows on one day give 0 and a
    single row gives null.  The window sees at most one row per calendar day.
    """
    days = (
        df.where(F.col(quoted(column)).isNotNull())
        .groupBy(F.to_date(quoted(column)).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    gap = F.datediff("day", F.lag("day").over(W.orderBy("day")))
    same_day = F.when(F.col("n") > 1, 0)
    return days.select(F.greatest(gap, same_day).alias("gap")).agg(F.max("gap").alias("largest_gap_days"))
