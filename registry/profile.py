"""Table and column profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import (
    BLANK_CONVERSATIONS, LI_NULLS, ORDERS_COPIES, TABLE_COLUMNS, blank_conversations, li_nulls, numeric_of,
    orders_copies, read, shown, text_key, union_all,
)
from tablescope import schema as S
from tablescope.functions import TEXT_PATTERNS, text_pattern
from tablescope.operators import frequency, numeric, tables, temporal, text
from tablescope.plans.profile import column_profile

LI = TABLE_COLUMNS["lineitem"]
LI_NUMERIC = numeric_of("lineitem")
EVENT_TEXT = ["event_type", "props"]


def _joined(array: str):
    return F.array_join(F.col(array), ",")


def _texts_of(spark, sf):
    """Every text shape of the tables in one column: urls, prose, codes, names."""
    parts = [
        read(spark, sf, "pages").select(F.col("url").alias("value")),
        read(spark, sf, "customer").select(F.col("c_name").alias("value")),
        read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value")),
        read(spark, sf, "orders").select(F.concat(F.lit(" a"), "o_custkey", F.lit("@x.org ")).alias("value")),
        blank_conversations(spark, sf).select(F.col("role").alias("value")),
        blank_conversations(spark, sf).select(F.col("text").alias("value")),
        read(spark, sf, "orders").select(F.col("o_orderpriority").alias("value")),
        read(spark, sf, "part").select(F.col("p_name").alias("value")),
        read(spark, sf, "part").select(F.concat(F.lit("+"), F.col("p_partkey") + 1000000).alias("value")),
    ]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


_TEXTS = """(SELECT url AS value FROM pages UNION ALL SELECT c_name FROM customer
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT ' a' || o_custkey || '@x.org ' FROM orders
    UNION ALL SELECT role FROM conversations UNION ALL SELECT CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END FROM conversations
    UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT p_name FROM part
    UNION ALL SELECT '+' || (p_partkey + 1000000) FROM part)"""

def _profile_embeddings(spark, sf):
    """A table with a column of an unsupported type, some of it null: its shares stand beside the full statistics of others."""
    df = read(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")))
    return column_profile(df).select("column_name", "data_type", "total_count", F.round("null_percentage", 6).alias("null_percentage"), "unique_count", "max_value")


QUERIES = {
    "profile_embeddings": _profile_embeddings,
    "table_summary": lambda spark, sf: tables.table_summary(
        orders_copies(spark, sf), "orders", target="o_orderstatus", exclude=["o_orderkey"]
    ),
    "duplicate_rows": lambda spark, sf: tables.duplicate_rows(orders_copies(spark, sf)),
    "duplicate_documents": lambda spark, sf: tables.duplicate_rows(read(spark, sf, "documents").drop("doc_id")),
    "exclude_columns": lambda spark, sf: tables.exclude_columns(read(spark, sf, "customer"), ["c_name", "c_acctbal"]),
    "metric_sets": lambda spark, sf: tables.metric_sets(read(spark, sf, "lineitem")),
    "null_stats": lambda spark, sf: tables.null_stats(li_nulls(spark, sf)),
    "unique_stats": lambda spark, sf: frequency.unique_stats(li_nulls(spark, sf)),
    "basic_profile": lambda spark, sf: tables.basic_profile(li_nulls(spark, sf)),
    "full_profile": lambda spark, sf: column_profile(li_nulls(spark, sf)),
    "full_profile_documents": lambda spark, sf: column_profile(read(spark, sf, "documents")),
    "candidate_profile": lambda spark, sf: tables.candidate_profile(read(spark, sf, "orders"), ["o_orderkey"]),
    "numeric_basic": lambda spark, sf: numeric.numeric_basic(li_nulls(spark, sf)),
    "numeric_kurtosis": lambda spark, sf: numeric.numeric_kurtosis(li_nulls(spark, sf)),
    "numeric_quartiles": lambda spark, sf: numeric.numeric_quartiles(li_nulls(spark, sf)),
    "percentile_profile": lambda spark, sf: numeric.percentile_profile(li_nulls(spark, sf)),
    "iqr_outliers": lambda spark, sf: numeric.iqr_outliers(read(spark, sf, "events")),
    "pearson_skew": lambda spark, sf: numeric.pearson_skewness(read(spark, sf, "events")),
    "value_modes": lambda spark, sf: frequency.frequency_summary(li_nulls(spark, sf)).select(
        "column_name", "mode_value", "mode_count"
    ),
    "entropy": lambda spark, sf: frequency.frequency_summary(li_nulls(spark, sf)).select("column_name", "entropy"),
    "entropy_nonnull": lambda spark, sf: frequency.frequency_summary(li_nulls(spark, sf)).select(
        "column_name", "entropy_nonnull"
    ),
    "top_values": lambda spark, sf: frequency.top_values(li_nulls(spark, sf)),
    "top_values_documents": lambda spark, sf: frequency.top_values(read(spark, sf, "documents")),
    "bottom_values": lambda spark, sf: frequency.bottom_values(li_nulls(spark, sf)),
    "concentration_top3": lambda spark, sf: frequency.concentration(li_nulls(spark, sf)),
    "date_range": lambda spark, sf: temporal.date_range(read(spark, sf, "orders"), "o_orderdate"),
    "by_year": lambda spark, sf: temporal.by_year(read(spark, sf, "orders"), "o_orderdate"),
    "by_month": lambda spark, sf: temporal.by_month(read(spark, sf, "orders"), "o_orderdate"),
    "by_day_of_week": lambda spark, sf: temporal.by_day_of_week(read(spark, sf, "events"), "ts"),
    "largest_gap": lambda spark, sf: temporal.largest_gap(read(spark, sf, "orders"), "o_orderdate"),
    "largest_gap_events": lambda spark, sf: temporal.largest_gap(read(spark, sf, "events"), "ts"),
    "text_length": lambda spark, sf: text.text_length(read(spark, sf, "documents")),
    "empty_strings": lambda spark, sf: text.empty_strings(blank_conversations(spark, sf)),
    "pattern_counts": lambda spark, sf: text.pattern_counts(_texts_of(spark, sf)),
    "pattern_classes": lambda spark, sf: read(spark, sf, "pages").select("page_id", text_pattern(F.col("url")).alias("pattern")),
    "truncate_text": lambda spark, sf: text.truncate_text(read(spark, sf, "documents").select("doc_id", "text"), "text"),
}


def _per_column(columns: list[str], template: str) -> str:
    return union_all([template.replace("{c}", c) for c in columns])


def _frequencies(source: str, c: str, kind: str) -> str:
    """(k, v, n): key, value and count of each non-null value."""
    return (
        f"(SELECT {text_key(c, kind)} AS k, min({c}) AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)"
    )


def _entropy(source: str, c: str, whole: str) -> str:
    return f"""(SELECT round(abs(sum(n::DOUBLE / t * log2(n::DOUBLE / t))), 2) FROM
        (SELECT count(*) AS n, (SELECT {whole} FROM {source}) AS t FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}))"""


def _mode(source: str, c: str, kind: str, what: str = "v") -> str:
    value = shown("v", kind) if what == "v" else what
    return f"(SELECT {value} FROM {_frequencies(source, c, kind)} ORDER BY n DESC, k LIMIT 1)"


def _profile_row(source: str, c: str, kind: str) -> str:
    numeric_kind = kind in ("bigint", "int", "double")
    null = "CAST(NULL AS DOUBLE)"
    few = "u <= 100"
    categorical = "TRUE" if kind == "string" else few
    if numeric_kind:
        q = {p: f"round(quantile_cont({c}::DOUBLE, {p}), 2)" for p in (0.25, 0.5, 0.75)}
        values = f"""round(avg({c}), 2) AS m, {q[0.5]} AS med, round(stddev_samp({c}), 2) AS sd,
            {shown(f'min({c})', kind)} AS lo, {shown(f'max({c})', kind)} AS hi, {q[0.25]} AS q1, {q[0.75]} AS q3"""
    else:
        values = f"""{null} AS m, {null} AS med, {null} AS sd, CAST(NULL AS VARCHAR) AS lo, CAST(NULL AS VARCHAR) AS hi,
            {null} AS q1, {null} AS q3"""
    outliers = (
        f"""(SELECT round(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0
            / count(*), 2) FROM {source})""" if numeric_kind else null
    )
    skew = "CASE WHEN sd > 0 THEN round(3 * (m - med) / sd, 2) END"
    mode = _mode(source, c, kind)
    return f"""SELECT '{c}' AS column_name, '{kind}' AS data_type, total AS total_count,
        (total - filled) * 100.0::DOUBLE / total AS null_percentage, u AS unique_count, u::DOUBLE / total AS cardinality_ratio,
        m AS mean_value, med AS median_value,
        CASE WHEN {'TRUE' if numeric_kind else categorical} THEN {mode} END AS mode_value, sd AS std_dev,
        lo AS min_value, hi AS max_value, q1, q3, {skew if numeric_kind else null} AS skewness,
        {outliers} AS outlier_percentage, CASE WHEN {categorical} THEN {_entropy(source, c, 'count(*)')} END AS entropy
        FROM (SELECT count(*) AS total, count({c}) AS filled, count(DISTINCT {c}) AS u, {values} FROM {source})"""


def _top(source: str, c: str, kind: str, limit: int, direction: str) -> str:
    return f"""SELECT '{c}' AS column_name, rank, {shown('v', kind)} AS value, n AS count,
        n * 100.0::DOUBLE / (SELECT count(*) FROM {source}) AS percentage FROM (
        SELECT CAST(row_number() OVER (ORDER BY n {direction}, k) AS INTEGER) AS rank, v, n
        FROM {_frequencies(source, c, kind)}) WHERE rank <= {limit}"""


def _family(kind: str) -> str:
    return {"string": "text", "timestamp_ntz": "datetime"}.get(kind, "numeric")


def _sets(c: str, kind: str) -> str:
    family = _family(kind)
    return f"""SELECT '{c}' AS column_name, '{family}' AS family, count(DISTINCT {c}) AS unique_count,
        {family == 'numeric'} AS "numeric", {family == 'text'} OR count(DISTINCT {c}) <= 100 AS categorical,
        {family == 'datetime'} AS datetime, {family == 'text'} AS "text" FROM lineitem"""


def _candidate(i: int, c: str, kind: str) -> str:
    numeric_kind = kind in ("bigint", "int", "double")
    stats = (
        f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std"
        if numeric_kind
        else ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("min", "max", "mean", "std"))
    )
    return f"""SELECT '{c}' AS column_name, {i} AS ordinal, '{kind}' AS data_type, count(*) - count({c}) AS null_count,
        round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_percentage, {stats},
        count(DISTINCT {c}) AS distinct_count,
        (SELECT string_agg({shown('v', kind)}, ', ' ORDER BY o_orderkey) FROM (SELECT {c} AS v, o_orderkey FROM orders
            WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 5)) AS sample_values FROM orders"""


def _busiest(part: str, name: str) -> str:
    return f"""SELECT CAST({part}(o_orderdate) AS INTEGER) AS {name}, count(*) AS count FROM orders
        WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY count DESC, {name} LIMIT 5"""


def _gap(c: str, table: str) -> str:
    return f"""SELECT CAST(max(date_diff('day', before, {c})) AS INTEGER) AS largest_gap_days FROM (
        SELECT {c}, lag({c}) OVER (ORDER BY {c}) AS before FROM {table} WHERE {c} IS NOT NULL)"""


_CLASS = "CASE WHEN t = '' THEN NULL " + " ".join(
    f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TEXT_PATTERNS.items()
) + " END"
_BASIC = _per_column(
    list(LI),
    f"""SELECT '{{c}}' AS column_name, count(*) AS total_count,
        (count(*) - count({{c}})) * 100.0::DOUBLE / count(*) AS null_percentage,
        count(DISTINCT {{c}}) AS unique_count, count(DISTINCT {{c}})::DOUBLE / count(*) AS cardinality_ratio FROM {LI_NULLS}""",
)
_TYPES = "CASE column_name " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in LI.items()) + " END AS data_type"

SQL = {
    "profile_embeddings": """WITH e AS (SELECT * REPLACE (CASE WHEN vec_id % 7 <> 0 THEN embedding END AS embedding) FROM embeddings)
        SELECT 'vec_id' AS column_name, 'bigint' AS data_type, count(*) AS total_count, round((count(*) - count(vec_id)) * 100.0::DOUBLE / count(*), 6) AS null_percentage,
        count(DISTINCT vec_id) AS unique_count, CAST(max(vec_id) AS VARCHAR) AS max_value FROM e
        UNION ALL SELECT 'embedding', 'array<float>', count(*), round((count(*) - count(embedding)) * 100.0::DOUBLE / count(*), 6), NULL, NULL FROM e
        UNION ALL SELECT 'label', 'int', count(*), round((count(*) - count(label)) * 100.0::DOUBLE / count(*), 6), count(DISTINCT label), CAST(max(label) AS VARCHAR) FROM e""",
    "table_summary": f"""SELECT 'orders' AS table_name, count(*) AS total_rows, 5 AS total_columns, count(*) - d AS duplicate_rows,
        round((count(*) - d) * 100.0 / count(*), 2) AS duplicate_percentage, 'o_orderstatus' AS target_column,
        'supervised' AS analysis_type FROM {ORDERS_COPIES}, (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM {ORDERS_COPIES}))
        GROUP BY d""",
    "duplicate_rows": f"""SELECT count(*) AS total_rows, count(*) - d AS duplicate_rows,
        round((count(*) - d) * 100.0 / count(*), 2) AS duplicate_percentage
        FROM {ORDERS_COPIES}, (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM {ORDERS_COPIES})) GROUP BY d""",
    "duplicate_documents": """SELECT count(*) AS total_rows, count(*) - d AS duplicate_rows,
        round((count(*) - d) * 100.0 / count(*), 2) AS duplicate_percentage
        FROM documents, (SELECT count(*) AS d FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) GROUP BY d""",
    "exclude_columns": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    "metric_sets": union_all([_sets(c, t) for c, t in LI.items()]),
    "null_stats": _per_column(
        list(LI),
        f"""SELECT '{{c}}' AS column_name, count(*) AS total_count, count(*) - count({{c}}) AS null_count,
            (count(*) - count({{c}})) * 100.0::DOUBLE / count(*) AS null_percentage FROM {LI_NULLS}""",
    ),
    "unique_stats": f"SELECT column_name, total_count, unique_count, cardinality_ratio FROM ({_BASIC})",
    "basic_profile": f"SELECT *, {_TYPES} FROM ({_BASIC})",
    "full_profile": union_all([_profile_row(LI_NULLS, c, t) for c, t in LI.items()]),
    "full_profile_documents": union_all([_profile_row("documents", c, t) for c, t in TABLE_COLUMNS["documents"].items()]),
    "candidate_profile": union_all([_candidate(i, c, t) for i, (c, t) in enumerate(TABLE_COLUMNS["orders"].items())]),
    "numeric_basic": _per_column(
        LI_NUMERIC,
        f"""SELECT '{{c}}' AS column_name, round(avg({{c}}), 2) AS mean_value, round(stddev_samp({{c}}), 2) AS std_dev,
            round(var_samp({{c}}), 2) AS variance, min({{c}})::DOUBLE AS min_value, max({{c}})::DOUBLE AS max_value FROM {LI_NULLS}""",
    ),
    "numeric_kurtosis": _per_column(
        LI_NUMERIC, f"SELECT '{{c}}' AS column_name, round(kurtosis_pop({{c}}), 4) AS kurtosis FROM {LI_NULLS}"
    ),
    "numeric_quartiles": _per_column(
        LI_NUMERIC,
        f"""SELECT '{{c}}' AS column_name, round(quantile_cont({{c}}::DOUBLE, 0.25), 2) AS q1,
            round(quantile_cont({{c}}::DOUBLE, 0.5), 2) AS median_value, round(quantile_cont({{c}}::DOUBLE, 0.75), 2) AS q3 FROM {LI_NULLS}""",
    ),
    "percentile_profile": _per_column(
        LI_NUMERIC,
        "SELECT '{c}' AS column_name, "
        + ", ".join(f"round(quantile_cont({{c}}::DOUBLE, {p / 100}), 2) AS p{p}" for p in S.PERCENTILES)
        + f" FROM {LI_NULLS}",
    ),
    "iqr_outliers": _per_column(
        numeric_of("events"),
        """SELECT '{c}' AS column_name, round(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))
            * 100.0 / count(*), 2) AS outlier_percentage FROM events, (SELECT round(quantile_cont({c}::DOUBLE, 0.25), 2) AS q1,
            round(quantile_cont({c}::DOUBLE, 0.75), 2) AS q3 FROM events)""",
    ),
    "pearson_skew": _per_column(
        numeric_of("events"),
        """SELECT '{c}' AS column_name, m AS mean_value, med AS median_value, sd AS std_dev,
            CASE WHEN sd > 0 THEN round(3 * (m - med) / sd, 2) END AS skewness FROM (SELECT round(avg({c}), 2) AS m,
            round(quantile_cont({c}::DOUBLE, 0.5), 2) AS med, round(stddev_samp({c}), 2) AS sd FROM events)""",
    ),
    "value_modes": union_all(
        [
            f"SELECT '{c}' AS column_name, {_mode(LI_NULLS, c, t)} AS mode_value, {_mode(LI_NULLS, c, t, 'n')} AS mode_count"
            for c, t in LI.items()
        ]
    ),
    "entropy": union_all([f"SELECT '{c}' AS column_name, {_entropy(LI_NULLS, c, 'count(*)')} AS entropy" for c in LI]),
    "entropy_nonnull": union_all(
        [f"SELECT '{c}' AS column_name, {_entropy(LI_NULLS, c, f'count({c})')} AS entropy_nonnull" for c in LI]
    ),
    "top_values": union_all([_top(LI_NULLS, c, t, 10, "DESC") for c, t in LI.items()]),
    "top_values_documents": union_all([_top("documents", c, t, 10, "DESC") for c, t in TABLE_COLUMNS["documents"].items()]),
    "bottom_values": union_all([_top(LI_NULLS, c, t, 5, "ASC") for c, t in LI.items()]),
    "concentration_top3": union_all(
        [
            f"""SELECT '{c}' AS column_name, round((SELECT sum(n) FROM (SELECT n FROM {_frequencies(LI_NULLS, c, t)}
            ORDER BY n DESC LIMIT 3)) * 100.0 / (SELECT count(*) FROM {LI_NULLS}), 2) AS concentration_top3"""
            for c, t in LI.items()
        ]
    ),
    "date_range": """SELECT min(o_orderdate) AS min_date, max(o_orderdate) AS max_date,
        CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS INTEGER) AS date_range_days FROM orders""",
    "by_year": _busiest("year", "year"),
    "by_month": _busiest("month", "month"),
    "by_day_of_week": "SELECT CAST(dayofweek(ts) AS INTEGER) AS day, count(*) AS count FROM events GROUP BY 1",
    "largest_gap": _gap("o_orderdate", "orders"),
    "largest_gap_events": _gap("ts", "events"),
    "text_length": _per_column(
        ["text", "lang", "source"],
        """SELECT '{c}' AS column_name, round(avg(length({c})), 2) AS avg_length, CAST(min(length({c})) AS INTEGER) AS min_length,
            CAST(max(length({c})) AS INTEGER) AS max_length FROM documents""",
    ),
    "empty_strings": _per_column(
        ["role", "text"],
        f"""SELECT '{{c}}' AS column_name, count(*) FILTER (WHERE length(trim({{c}})) = 0) AS empty_string_count,
            round(count(*) FILTER (WHERE length(trim({{c}})) = 0) * 100.0 / count(*), 2) AS empty_string_percentage
            FROM {BLANK_CONVERSATIONS}""",
    ),
    "pattern_counts": "SELECT 'value' AS column_name, "
    + ", ".join(f"count(*) FILTER (WHERE p = '{n}') AS {n}" for n in TEXT_PATTERNS)
    + f" FROM (SELECT {_CLASS} AS p FROM (SELECT trim(value) AS t FROM {_TEXTS}))",
    "pattern_classes": f"SELECT page_id, {_CLASS} AS pattern FROM (SELECT page_id, trim(url) AS t FROM pages)",
    "truncate_text": """SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN length(text) > 1000
        THEN substring(text, 1, 1000) || '...' ELSE text END AS text FROM documents""",
}
