"""Totals along a global order, without ever putting the whole order into one task.

A window without PARTITION BY sorts everything in a single task.  Here the rows are range
partitioned, each range knows the totals of the ranges before it, and the window only runs
inside a range.  The partition numbers are frozen by a checkpoint before they are used twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope.schema import quoted
from tablescope.session import checkpointed

_PART = "__part"


def totals_before(
    df: DataFrame,
    order: list[str],
    totals: dict[str, Column],
    within: list[str] | None = None,
    keep_partitioning: bool = False,
) -> DataFrame:
    """Add, for each entry of ``totals``, its sum over all rows before the current one.

    ``within`` restarts the totals per group; the ranges run over (within, order), so a group
    may span many ranges.  With ``keep_partitioning`` the rows stay where they are and the
    present partitions play the part of the ranges: the way to number rows whose order does
    not matter, such as identical copies.
    """
    within = within or []
    keys = [quoted(c) for c in within]
    sort = [quoted(c) for c in order]
    placed = df if keep_partitioning else df.repartitionByRange(*keys, *sort)
    placed = checkpointed(placed.withColumn(_PART, F.spark_partition_id()))

    per_part = placed.groupBy(*keys, _PART).agg(
        *[F.sum(expr).alias(f"__sum_{name}") for name, expr in totals.items()]
    )
    # One row per range (and group): as many rows as there are tasks, not rows of data.
    earlier = W.partitionBy(*keys).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select(
        *[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)],
        F.col(_PART).alias("__offset_part"),
        *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__off_{n}") for n in totals],
    )
    match = F.col(_PART) == F.col("__offset_part")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__key_{i}"))
    inside = W.partitionBy(*keys, _PART).orderBy(*(sort or [_PART])).rowsBetween(W.unboundedPreceding, -1)
    joined = placed.join(offsets, match)
    return joined.select(
        *[quoted(c) for c in df.columns],
        *[
            (F.col(f"__off_{n}") + F.coalesce(F.sum(expr).over(inside), F.lit(0))).alias(n)
            for n, expr in totals.items()
        ],
    )


def dense_codes(values: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Codes 0..k-1 of the distinct values of ``column`` in ascending order."""
    distinct = values.select(quoted(column)).distinct()
    return totals_before(distinct, [column], {code: F.lit(1)}).withColumn(
        code, F.col(code).cast("bigint")
    )
