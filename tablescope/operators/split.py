"""Exact stratified train/test split, the same on any cluster and any partitioning.

Rows are ordered by a hash of (seed, key), and the first ``quota`` rows of each class train.  One path
serves any number of classes: quotas are a frame with a row per class; a count per class and stretch of the
hash tells in which stretch each class reaches its quota; the values of these stretches alone are counted
one by one, which gives the hash at the cut.  Rows at the very cut, copies of one key, are numbered where
they lie, by the number of such rows in the partitions before.  No class, key or stretch is gathered, and
no class reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescope import schema as S
from tablescope.operators.lookup import look_up
from tablescope.operators.ordering import totals_before
from tablescope.session import checkpointed

HASH_DIGITS = 13  # 52 bits, exact as a double
STRETCHES = 4096  # of the hash, per class


def row_hash(keys: list[str], seed: int) -> Column:
    """Hash of the key columns as a whole number below 2 ** 52."""
    cells = [F.coalesce(F.col(S.quoted(k)).cast("string"), F.lit("\u0000")) for k in keys]
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), *cells))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double")


def train_quotas(counts: DataFrame, test_size: float) -> tuple[DataFrame, int]:
    """(class, rows, quota) with the training rows of each class, and the number of classes.

    Quotas are proportional, largest remainders rounded up; ties of remainders go by class.  The sums
    are one row, the classes stay a frame.
    """
    total, classes, fewest = counts.agg(F.sum("rows"), F.count(F.lit(1)), F.min("rows")).first()
    total = total or 0
    n_train = total - -int(-(test_size * total) // 1)
    if not classes or fewest < 2:
        raise ValueError("every class needs at least two rows for a stratified split")
    if n_train < classes or total - n_train < classes:
        raise ValueError("too few rows to put every class on both sides of the split")
    share = F.lit(float(n_train)) * F.col("rows") / F.lit(float(total))
    shares = counts.withColumns({"whole": F.floor(share), "left": -(share - F.floor(share))})
    spare = n_train - shares.agg(F.sum("whole")).first()[0]
    placed = totals_before(shares, ["left", "class"], {"place": F.lit(1)})
    quota = F.col("whole") + F.when(F.col("place") < spare, 1).otherwise(0)
    return placed.select("class", "rows", quota.alias("quota")), classes


def by_class(rows: DataFrame, facts: DataFrame, classes: int) -> DataFrame:
    """``rows`` (with ``__class``) and the columns of their class in ``facts`` (with ``class``, a row each)."""
    salt = F.xxhash64("__hash", F.spark_partition_id())
    return look_up(rows, F.col("__class"), facts.withColumnRenamed("class", "of"), classes, salt)


def _reached(counts: DataFrame, by: str, before: Column) -> DataFrame:
    """Of (class, by, n) rows the one in which each class reaches its quota, and the rows below it."""
    upto = F.sum("n").over(W.partitionBy("class").orderBy(by).rowsBetween(W.unboundedPreceding, -1))
    below = before + F.coalesce(upto, F.lit(0))
    found = counts.withColumn("below", below)
    return found.where((F.col("below") < F.col("quota")) & (F.col("below") + F.col("n") >= F.col("quota")))


def class_cuts(hashed: DataFrame, quotas: DataFrame, classes: int) -> DataFrame:
    """(class, cut, room, ties): the hash at which a class reaches its quota, the places left there, and its rows."""
    stretch = F.floor(F.col("__hash") / (16**HASH_DIGITS // STRETCHES)).cast("int")
    counted = hashed.groupBy(F.col("__class").alias("class"), stretch.alias("stretch")).agg(F.count(F.lit(1)).alias("n"))
    known = quotas.select(F.col("class").alias("of"), "quota")
    counted = counted.join(known, F.col("class").eqNullSafe(F.col("of"))).drop("of")
    at = checkpointed(_reached(counted, "stretch", F.lit(0)).select("class", "stretch", "quota", "below"))

    inside = by_class(hashed.select("__class", "__hash"), at, classes).where(stretch == F.col("stretch"))
    values = inside.groupBy(F.col("__class").alias("class"), "__hash", "quota", F.col("below").alias("first")).agg(F.count(F.lit(1)).alias("n"))
    cut = _reached(values, "__hash", F.col("first"))
    return cut.select("class", F.col("__hash").alias("__cut"), (F.col("quota") - F.col("below")).alias("__room"), F.col("n").alias("__ties"))


def stratified_split(
    df: DataFrame, label: str, keys: list[str], test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` ('train' / 'test') with exact quotas per class.

    ``keys`` should identify a row.  Rows with the same hash at the very cut are numbered to
    keep the quota exact.  A class whose quota is 0 has test rows only; a null label is a class.
    """
    hashed = df.withColumns({"__hash": row_hash(keys, seed), "__class": F.col(S.quoted(label))})
    counts = checkpointed(df.groupBy(F.col(S.quoted(label)).alias("class")).agg(F.count(F.lit(1)).alias("rows")))
    quotas, classes = train_quotas(counts, test_size)
    cuts = class_cuts(hashed, quotas, classes)
    none = quotas.where("quota = 0").select("class", F.lit(-1.0).alias("__cut"), F.lit(0).cast("bigint").alias("__room"), F.lit(0).cast("bigint").alias("__ties"))
    cuts = checkpointed(cuts.unionByName(none))

    placed = by_class(hashed, cuts, classes)
    own = ["__hash", "__class", "__cut", "__room", "__ties"]
    if cuts.where("__room < __ties").isEmpty():
        return placed.withColumn("split", F.when(F.col("__hash") <= F.col("__cut"), "train").otherwise("test")).drop(*own)
    # copies of one key straddle a cut: number them where they lie, without gathering them
    straddling = (F.col("__hash") == F.col("__cut")) & (F.col("__room") < F.col("__ties"))
    numbered = totals_before(placed.where(straddling), [], {"__place": F.lit(1)}, within=["__class"], keep_partitioning=True)
    ties = numbered.withColumn("split", F.when(F.col("__place") < F.col("__room"), "train").otherwise("test")).drop("__place", *own)
    side = F.when(F.col("__hash") <= F.col("__cut"), "train").otherwise("test")
    return placed.where(~straddling).withColumn("split", side).drop(*own).unionByName(ties)


def hash_split(df: DataFrame, keys: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """The one-pass variant: shares hold on average, no statistics are needed."""
    limit = (1 - test_size) * 16**HASH_DIGITS
    return df.withColumn("split", F.when(row_hash(keys, seed) < limit, "train").otherwise("test"))
