"""Rank prediction targets by how well the other columns explain them.

Every value of a column counts, of text and numbers alike: cells are compared by 64-bit hashes, and pairs of
cells are counted as they are. Only numbers and dates with more values than ``levels`` are cut into deciles
first, as single prices or seconds would explain everything. Tasks count the cells of all column pairs for some
rows at a time, so only cells and their counts are shuffled, and no list of values passes through the driver.
Text columns that are nearly unique name their rows and explain nothing; they take no part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import schema as S
from tablescope.functions import finite, problem_type, round_half_up, safe_divide
from tablescope.operators.frequency import supported_columns, unique_stats
from tablescope.operators.quantiles import exact_quantiles
from tablescope.operators.tables import describe_table, null_stats

# workers get the functions of this module with each job, so they need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that a task counts at once.
ROWS_AT_ONCE = 100_000
# Fixed values of the ranking.
FEW_VALUES = 20
DECILES = [i / 10 for i in range(1, 10)]
LEAKAGE = 0.99
HIGH, MEDIUM = 0.5, 0.2
MAX_NULL_SHARE = 0.5
IDENTIFIER_RATIO = 0.95


def _as_number(df: DataFrame, name: str) -> Column | None:
    data_type = df.schema[name].dataType
    value = F.col(S.quoted(name))
    if S.is_numeric(data_type):
        return finite(value)
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    return None


def paired_columns(df: DataFrame, ratios: dict[str, float]) -> list[str]:
    """Columns that take part: all supported ones but texts whose values are nearly all different."""
    return [n for n in supported_columns(df) if _as_number(df, n) is not None or ratios[n] <= IDENTIFIER_RATIO]


def coded_columns(
    df: DataFrame, names: list[str], unique_counts: dict[str, int], levels: int = FEW_VALUES
) -> tuple[DataFrame, dict[int, list[float]]]:
    """Columns k0, k1, ...: the 64-bit hash of a value, with 0 for null; or a number that is cut by the edges of its column."""
    numbers = {n: _as_number(df, n) for n in names}
    base = df.select(
        *[
            (F.col(S.quoted(n)).cast("string") if numbers[n] is None else numbers[n]).alias(f"x{i}")
            for i, n in enumerate(names)
        ]
    )
    many = {n: i for i, n in enumerate(names) if numbers[n] is not None and unique_counts[n] > levels}
    edges = exact_quantiles(base, {n: F.col(f"x{i}") for n, i in many.items()}, DECILES) if many else {}
    codes = []
    for i, n in enumerate(names):
        x = F.col(f"x{i}")
        code = x if n in many else F.when(x.isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(x))
        codes.append(code.alias(f"k{i}"))
    # a column without finite numbers has no edges: all its rows are null
    return base.select(*codes), {i: edges[n] or [] for n, i in many.items()}


def _places(column: pa.ChunkedArray, edges: list[float] | None) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a column and each row's place among them; a decile's code is the number of edges below, from 1."""
    if edges is not None:
        x = column.to_numpy()  # null is NaN
        return np.arange(len(edges) + 2), np.where(np.isnan(x), 0, np.searchsorted(edges, x, side="left") + 1)
    coded = column.combine_chunks().dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


def _pairs_of(rows: pa.Table, edges: dict[int, list[float]]) -> Iterator[pa.RecordBatch]:
    """(pair, code_a, code_b, n) of some rows: the cells of each column pair (a, b) with a <= b."""
    width = rows.num_columns
    columns = [_places(rows.column(i), edges.get(i)) for i in range(width)]
    for a, (codes_a, place_a) in enumerate(columns):
        for b, (codes_b, place_b) in enumerate(columns[a:], a):
            cell = place_a if a == b else place_a * len(codes_b) + place_b
            cells = len(codes_a) * (1 if a == b else len(codes_b))
            if cells <= len(place_a):
                counts = np.bincount(cell, minlength=cells)
                at = np.flatnonzero(counts)
                counts = counts[at]
            else:
                at, counts = np.unique(cell, return_counts=True)
            own = (at, at) if a == b else (at // len(codes_b), at % len(codes_b))
            found = [np.full(len(at), a * width + b, np.int32), codes_a[own[0]], codes_b[own[1]], counts]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["pair", "code_a", "code_b", "n"])


def pair_counts(coded: DataFrame, edges: dict[int, list[float]]) -> DataFrame:
    """(pair, code_a, code_b, n) over all rows; tasks count some rows at a time, whatever the number of values."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= ROWS_AT_ONCE:
                yield from _pairs_of(pa.Table.from_batches(held), edges)
                held, rows = [], 0
        if rows:
            yield from _pairs_of(pa.Table.from_batches(held), edges)

    some = coded.mapInArrow(count, "pair int, code_a bigint, code_b bigint, n bigint")
    return some.groupBy("pair", "code_a", "code_b").agg(F.sum("n").alias("n"))


def associations(
    df: DataFrame, facts: dict[str, tuple[int, float]] | None = None, levels: int = FEW_VALUES
) -> DataFrame:
    """(column_name, partner, association) in both directions.

    Association is mutual information over the smaller entropy, so 1 means one column
    determines the other.  ``facts`` has the distinct values of each column and their share of
    the rows, where these are known.
    """
    if facts is None:
        facts = {r["column_name"]: (r["unique_count"], r["cardinality_ratio"]) for r in unique_stats(df).collect()}
    names = paired_columns(df, {n: ratio for n, (_, ratio) in facts.items()})
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, partner string, association double")
    # the pair (a, a) gives the entropy of a
    counted = pair_counts(*coded_columns(df, names, {n: unique for n, (unique, _) in facts.items()}, levels))
    sums = counted.groupBy("pair").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.log2("n")).alias("n_log_n")
    )
    # at most (columns ** 2) / 2 rows from here on, which are read three times
    sums = df.sparkSession.createDataFrame(sums.collect(), sums.schema)
    name_at = F.array(*[F.lit(n) for n in names])
    left = F.floor(F.col("pair") / len(names)).cast("int")
    right = (F.col("pair") % len(names)).cast("int")
    sums = sums.select(left.alias("a"), right.alias("b"), "rows", "n_log_n")
    single = sums.where("a = b").select("a", "n_log_n")
    joint = (
        sums.where("a <> b")
        .join(F.broadcast(single.select("a", F.col("n_log_n").alias("s_a"))), "a")
        .join(F.broadcast(single.select(F.col("a").alias("b"), F.col("n_log_n").alias("s_b"))), "b")
    )
    log_rows = F.log2("rows")
    h_a, h_b = (log_rows - F.col(s) / F.col("rows") for s in ("s_a", "s_b"))
    information = log_rows + (F.col("n_log_n") - F.col("s_a") - F.col("s_b")) / F.col("rows")
    strength = F.when(F.least(h_a, h_b) > 1e-9, F.greatest(F.lit(0.0), safe_divide(information, F.least(h_a, h_b))))
    pairs = joint.select("a", "b", round_half_up(F.coalesce(strength, F.lit(0.0)), 4).alias("association"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "association"))
    return both.select(
        F.get(name_at, F.col("a")).alias("column_name"), F.get(name_at, F.col("b")).alias("partner"), "association"
    )


def target_quality_rank(df: DataFrame, keep: int = 5) -> DataFrame:
    """The best prediction targets with score, predictability and suggested features."""
    stats = (
        unique_stats(df)
        .join(null_stats(df).select("column_name", "null_count"), "column_name")
        .join(describe_table(df).select("column_name", "ordinal", "data_type", "family"), "column_name")
    )
    rows = stats.collect()  # one row per column
    known = df.sparkSession.createDataFrame(rows, stats.schema)
    pairs = associations(df, {r["column_name"]: (r["unique_count"], r["cardinality_ratio"]) for r in rows})
    order = W.partitionBy("column_name").orderBy(F.desc("association"), F.asc("partner"))
    usable = pairs.where(F.col("association") <= LEAKAGE).withColumn("place", F.row_number().over(order))
    partner = F.struct("place", "partner")
    strongest = usable.groupBy("column_name").agg(
        F.avg(F.when(F.col("place") <= 3, F.col("association"))).alias("top3"),
        F.max("association").alias("best"),
        F.array_sort(F.collect_list(F.when(F.col("place") <= 6, partner))).alias("partners"),
    )
    leaks = pairs.where(F.col("association") > LEAKAGE).groupBy("column_name").agg(
        F.array_sort(F.collect_list("partner")).alias("leakage")
    )
    few = F.col("unique_count").between(2, FEW_VALUES)
    shape = F.when(few, 1.0).when(F.col("family") == "numeric", 0.7).otherwise(0.3)
    null_share = safe_divide(F.col("null_count"), F.col("total_count"))
    ratio = safe_divide(F.col("unique_count"), F.col("total_count"))
    integer = F.col("data_type").isin("tinyint", "smallint", "int", "bigint")
    identifier = ((F.col("family") != "numeric") | integer) & (ratio > IDENTIFIER_RATIO)
    best = F.coalesce("best", F.lit(0.0))
    score = F.round(
        100
        * (
            0.35 * F.coalesce("top3", F.lit(0.0))
            + 0.25 * shape
            + 0.25 * (1 - null_share)
            + 0.15 * (F.col("ordinal") + 1) / len(df.columns)
        ),
        0,
    ).cast("int")
    scored = (
        known.where((null_share <= MAX_NULL_SHARE) & (F.col("unique_count") >= 2) & ~identifier)
        .join(strongest, "column_name", "left")
        .join(leaks, "column_name", "left")
        .select(
            "column_name",
            "ordinal",
            score.alias("importance_score"),
            problem_type(F.col("family") == "numeric", F.col("unique_count")).alias("problem_type"),
            F.when(best >= HIGH, "HIGH").when(best >= MEDIUM, "MEDIUM").otherwise("LOW").alias("predictability"),
            F.coalesce(F.col("partners.partner"), F.array().cast("array<string>")).alias("suggested_features"),
            F.coalesce("leakage", F.array().cast("array<string>")).alias("leakage"),
        )
    )
    # one row per column of the table, so the ranking window is as small as the schema
    place = F.row_number().over(W.orderBy(F.desc("importance_score"), F.desc("ordinal")))
    return scored.withColumn("rank", place).where(F.col("rank") <= keep).drop("ordinal")
