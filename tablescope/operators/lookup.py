"""Join rows with a table of facts that has one row per key, however common a key is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BROADCAST = 50_000  # keys whose facts are sent to every task
COPIES = 32  # of each key's facts beyond, so that the rows of a common key are dealt to as many tasks


def look_up(rows: DataFrame, key: Column, facts: DataFrame, count: int, salt: Column | None = None) -> DataFrame:
    """``rows`` with the columns of the facts whose ``of`` equals ``key`` (nulls are equal); rows without facts go.

    ``count`` is the number of facts.  Up to MOST_BROADCAST they are broadcast; more are shuffled, each in
    COPIES copies, and a row meets the copy that ``salt`` (by default its place) picks.
    """
    same = F.col("__of").eqNullSafe(F.col("of"))
    rows = rows.withColumn("__of", key)
    if count <= MOST_BROADCAST:
        return rows.join(F.broadcast(facts), same).drop("of", "__of")
    copies = facts.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    number = salt if salt is not None else F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    dealt = rows.withColumn("__salt", F.pmod(number, F.lit(COPIES)).cast("int"))
    return dealt.join(copies, same & (F.col("__salt") == F.col("__copy"))).drop("of", "__of", "__salt", "__copy")
