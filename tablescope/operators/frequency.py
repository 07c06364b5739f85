"""Value frequencies of every column in one pass, and everything derived from them.

Columns of one key type are stacked into (column, value) rows and counted; partial aggregation
absorbs hot values before the shuffle.  Each type keeps its native key (no cast to text in the
shuffle) and reads only its own columns from the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope import schema as S
from tablescope.functions import LONG_TEXT, compact_text, display, percentage, safe_divide


def _key_type(data_type: T.DataType) -> str:
    if S.is_integral(data_type):
        return "bigint"
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return "double"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return data_type.simpleString()
    return "string"


def _key(df: DataFrame, name: str) -> Column:
    data_type = df.schema[name].dataType
    value = F.col(S.quoted(name))
    if S.is_text(data_type):
        return compact_text(value.cast("string"))
    return value.cast(_key_type(data_type))


def supported_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    chosen = columns if columns is not None else df.columns
    return [c for c in chosen if S.is_supported(df.schema[c].dataType)]


def value_counts(df: DataFrame, columns: list[str] | None = None) -> list[DataFrame]:
    """Frames (c INT, value <key type>, n BIGINT), one per key type; nulls are one value.

    ``c`` is the position of the column in ``df.columns``.
    """
    groups: dict[str, list[str]] = {}
    for name in supported_columns(df, columns):
        groups.setdefault(_key_type(df.schema[name].dataType), []).append(name)
    frames = []
    for names in groups.values():
        pairs = [x for n in names for x in (F.lit(df.columns.index(n)), _key(df, n))]
        if len(names) == 1:
            stacked = df.select(pairs[0].alias("c"), pairs[1].alias("value"))
        else:
            stacked = df.select(F.stack(F.lit(len(names)), *pairs).alias("c", "value"))
        frames.append(stacked.groupBy("c", "value").agg(F.count(F.lit(1)).alias("n")))
    return frames


def column_name(df: DataFrame, position: Column | str = "c") -> Column:
    """Column name of a position in the table (the map is as large as the schema)."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return F.get(names, F.col(position) if isinstance(position, str) else position)


def with_every_column(df: DataFrame, columns: list[str] | None, stats: DataFrame) -> DataFrame:
    """Left join per-column ``stats`` to the column list, so an empty table keeps its rows."""
    names = supported_columns(df, columns)
    entries = [F.struct(F.lit(df.columns.index(n)).alias("c"), F.lit(n).alias("column_name")) for n in names]
    listed = df.sparkSession.range(1).select(F.inline(F.array(*entries)))
    return listed.join(stats, "c", "left").drop("c")


def _union(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _display_value(frame: DataFrame) -> Column:
    return display(F.col("value"), frame.schema["value"].dataType)


def restore_long_text(df: DataFrame, found: DataFrame, value: str) -> DataFrame:
    """Replace digests in column ``value`` of the small frame ``found`` (column position ``c``).

    ``found`` has a few rows per column (modes, top values).  They are computed once and kept
    as a local frame, so looking the texts up does not run the frequency count again; the
    lookup joins the scan to them by broadcast and shuffles only the matching texts.
    """
    names = long_text_columns(df)
    if not names:
        return found
    rows = found.collect()
    local = df.sparkSession.createDataFrame(rows, found.schema)
    digests = {(r["c"], r[value]) for r in rows if len(r[value] or "") > LONG_TEXT}
    if not digests:
        return local
    keys = df.sparkSession.createDataFrame(sorted(digests), "c int, __key string")
    pairs = [x for n in names for x in (F.lit(df.columns.index(n)), F.col(S.quoted(n)).cast("string"))]
    texts = (
        df.select(F.stack(F.lit(len(names)), *pairs).alias("c", "__text"))
        .where(F.length("__text") > LONG_TEXT)
        .withColumn("__key", compact_text(F.col("__text")))
    )
    originals = (
        texts.join(F.broadcast(keys), ["c", "__key"], "left_semi")
        .groupBy("c", "__key")
        .agg(F.first("__text").alias("__text"))
        .withColumnRenamed("c", "__c")
    )
    match = (F.col("c") == F.col("__c")) & (F.col(value) == F.col("__key"))
    return (
        local.join(originals, match, "left")
        .withColumn(value, F.coalesce("__text", value))
        .drop("__c", "__key", "__text")
    )


def long_text_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Text columns that hold a value longer than the digest limit (one small job)."""
    names = [c for c in (columns or df.columns) if S.is_text(df.schema[c].dataType)]
    if not names:
        return []
    row = df.agg(*[F.max(F.length(S.quoted(n))).alias(f"m{i}") for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if (row[i] or 0) > LONG_TEXT]


def frequency_summary(
    df: DataFrame, columns: list[str] | None = None, texts_are_short: bool = False
) -> DataFrame:
    """One row per column: total, non-null and distinct counts, mode, both entropies.

    ``entropy`` divides by all rows, ``entropy_nonnull`` by the non-null ones.
    """
    partial = []
    for frame in value_counts(df, columns):
        filled = F.col("value").isNotNull()
        n = F.when(filled, F.col("n"))
        # most frequent first, then the smallest value
        best = F.min(F.when(filled, F.struct((-F.col("n")).alias("rank"), F.col("value"))))
        summary = frame.groupBy("c").agg(
            F.sum("n").alias("total_count"),
            F.coalesce(F.sum(n), F.lit(0)).alias("filled_count"),
            F.count(n).alias("unique_count"),
            F.sum(n * F.log2(n)).alias("n_log_n"),
            best.alias("best"),
        )
        mode = display(F.col("best.value"), frame.schema["value"].dataType)
        partial.append(
            summary.select(
                "c", "total_count", "filled_count", "unique_count", "n_log_n",
                mode.alias("mode_value"), (-F.col("best.rank")).alias("mode_count"),
            )
        )
    summary = _union(partial)
    if not texts_are_short:
        summary = restore_long_text(df, summary, "mode_value")

    # -sum(p log2 p) with p = n / N, opened up so that N is not needed before the sums
    def entropy(n_all: str) -> Column:
        total = F.col(n_all)
        bits = (F.col("filled_count") * F.log2(total) - F.col("n_log_n")) / total
        return F.when(F.col("filled_count") > 0, F.round(F.abs(bits), 2))

    return with_every_column(df, columns, summary).select(
        "column_name",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_count", "filled_count", "unique_count")],
        "mode_value", "mode_count",
        entropy("total_count").alias("entropy"),
        entropy("filled_count").alias("entropy_nonnull"),
    )


def unique_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct non-null values of each column and their share of all rows."""
    parts = []
    for frame in value_counts(df, columns):
        parts.append(
            frame.groupBy("c").agg(
                F.sum("n").alias("total_count"), F.count("value").alias("unique_count")
            )
        )
    ratio = safe_divide(F.col("unique_count"), F.col("total_count"))
    return with_every_column(df, columns, _union(parts)).select(
        "column_name",
        F.coalesce("total_count", F.lit(0)).alias("total_count"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        ratio.alias("cardinality_ratio"),
    )


def approximate_unique_stats(df: DataFrame, columns: list[str] | None = None, error: float = 0.01) -> DataFrame:
    """The opt-in for huge tables: distinct counts from a sketch, in one pass without a shuffle."""
    names = supported_columns(df, columns)
    entries = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.count(F.lit(1)).alias("total_count"),
            F.approx_count_distinct(_key(df, n), error).alias("unique_count"),
        ).alias(f"u{i}")
        for i, n in enumerate(names)
    ]
    wide = df.agg(*entries)
    return wide.select(F.inline(F.array(*[F.col(f"u{i}") for i in range(len(names))])))


def ranked_values(
    df: DataFrame, limit: int, columns: list[str] | None = None, rarest: bool = False
) -> DataFrame:
    """The ``limit`` commonest (or rarest) values per column with count and % of all rows.

    The rank filter is pushed below the shuffle as a per-task top-k, so a column with many
    values never meets in one task as a whole.
    """
    frames = value_counts(df, columns)
    total = F.lit(df.count())
    order = F.col("n").asc() if rarest else F.col("n").desc()
    w = W.partitionBy("c").orderBy(order, F.col("value").asc())
    parts = []
    for frame in frames:
        top = (
            frame.where(F.col("value").isNotNull())
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= limit)
        )
        parts.append(top.select("c", "rank", _display_value(frame).alias("value"), "n"))
    found = restore_long_text(df, _union(parts), "value")
    return found.select(
        column_name(df).alias("column_name"),
        "rank",
        "value",
        F.col("n").alias("count"),
        safe_divide(F.col("n") * 100, total).alias("percentage"),
    )


def top_values(df: DataFrame, columns: list[str] | None = None, limit: int = S.TOP_VALUES) -> DataFrame:
    return ranked_values(df, limit, columns)


def bottom_values(df: DataFrame, columns: list[str] | None = None, limit: int = S.BOTTOM_VALUES) -> DataFrame:
    return ranked_values(df, limit, columns, rarest=True)


def concentration(df: DataFrame, columns: list[str] | None = None, k: int = 3) -> DataFrame:
    """% of all rows covered by the ``k`` commonest values of each column."""
    total = F.lit(df.count())
    parts = []
    w = W.partitionBy("c").orderBy(F.col("n").desc())
    for frame in value_counts(df, columns):
        filled = frame.where(F.col("value").isNotNull())
        top = filled.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        parts.append(top.groupBy("c").agg(percentage(F.sum("n"), total).alias(f"concentration_top{k}")))
    return with_every_column(df, columns, _union(parts))
