"""Target analysis and target ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import LI_NULLS, TABLE_COLUMNS, li_nulls, numeric_of, read, union_all
from tablescope.functions import distribution_shape
from tablescope.operators import association, numeric, target

ORDERS = TABLE_COLUMNS["orders"]
LI = TABLE_COLUMNS["lineitem"]


def _text(frame, *arrays):
    return frame.withColumns({a: F.array_join(F.col(a), ",") for a in arrays})


def shapes(spark, sf):
    skew = numeric.pearson_skewness(read(spark, sf, "events"))
    return skew.select("column_name", distribution_shape(F.col("skewness")).alias("shape"))


def _part(spark, sf):
    """part and the first word of its name: a column of 64 values that determines another."""
    return read(spark, sf, "part").withColumn("p_first", F.split_part("p_name", F.lit(" "), F.lit(1)))


def _ranked(frame):
    return _text(association.target_quality_rank(frame), "suggested_features", "leakage")


QUERIES = {
    "associations_lineitem": lambda spark, sf: association.associations(read(spark, sf, "lineitem")),
    "target_quality_rank_lineitem": lambda spark, sf: _ranked(read(spark, sf, "lineitem")),
    "associations_part": lambda spark, sf: association.associations(_part(spark, sf)),
    "target_quality_rank_part": lambda spark, sf: _ranked(_part(spark, sf)),
    "infer_problem_type": lambda spark, sf: target.infer_problem_type(read(spark, sf, "lineitem")),
    "class_distribution": lambda spark, sf: target.class_distribution(read(spark, sf, "events"), "event_type"),
    "class_distribution_nulls": lambda spark, sf: target.class_distribution(li_nulls(spark, sf), "l_returnflag"),
    "class_balance": lambda spark, sf: target.class_balance(read(spark, sf, "labels"), "quality"),
    "class_balance_nulls": lambda spark, sf: target.class_balance(li_nulls(spark, sf), "l_returnflag"),
    "regression_target_stats": lambda spark, sf: target.regression_target_stats(read(spark, sf, "events"), "value"),
    "distribution_shape": shapes,
    "supervised_profile": lambda spark, sf: target.supervised_profile(read(spark, sf, "orders"), "o_orderstatus").select(
        "target_column", "problem_type", "num_classes", "majority_class_percentage", "minority_class_percentage",
        "balance_ratio",
    ),
    "supervised_profile_regression": lambda spark, sf: target.supervised_profile(
        read(spark, sf, "orders"), "o_totalprice"
    ).select("target_column", "problem_type", "mean", "median", "std_dev", "min", "max", "q1", "q3", "skewness", "distribution_shape"),
    "target_candidates": lambda spark, sf: _text(target.target_candidates(read(spark, sf, "lineitem")), "suggested_features"),
    "associations": lambda spark, sf: association.associations(read(spark, sf, "orders")),
    "target_quality_rank": lambda spark, sf: _text(
        association.target_quality_rank(read(spark, sf, "orders")), "suggested_features", "leakage"
    ),
}


def _problem(c: str, kind: str) -> str:
    number = kind in ("bigint", "int", "double")
    return f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count,
        CASE WHEN {number} AND count(DISTINCT {c}) > 20 THEN 'regression' WHEN count(DISTINCT {c}) = 2 THEN 'binary_classification'
        ELSE 'multiclass_classification' END AS problem_type FROM lineitem"""


def _distribution(source: str, c: str) -> str:
    return f"""SELECT {c} AS class, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM {source}), 2) AS percentage
        FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}"""


def _balance(source: str, c: str) -> str:
    return f"""SELECT count(*) AS num_classes, round(max(n) * 100.0 / any_value(t), 2) AS majority_class_percentage,
        round(min(n) * 100.0 / any_value(t), 2) AS minority_class_percentage, round(min(n)::DOUBLE / max(n), 2) AS balance_ratio
        FROM (SELECT count(*) AS n, (SELECT count(*) FROM {source}) AS t FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})"""


_SHAPE = """CASE WHEN skewness IS NULL THEN 'unknown' WHEN abs(skewness) < 0.5 THEN 'approximately_normal'
    WHEN skewness > 1 THEN 'right_skewed' WHEN skewness > 0 THEN 'moderately_right_skewed'
    WHEN skewness < -1 THEN 'left_skewed' ELSE 'moderately_left_skewed' END"""


def _regression(source: str, c: str) -> str:
    return f"""(SELECT *, CASE WHEN std_dev > 0 THEN round(3 * (mean - median) / std_dev, 2) END AS skewness FROM (
        SELECT round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std_dev, round(min({c}), 2) AS min, round(max({c}), 2) AS max,
        round(quantile_cont({c}::DOUBLE, 0.25), 2) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 2) AS median,
        round(quantile_cont({c}::DOUBLE, 0.75), 2) AS q3 FROM {source}))"""


def _candidates() -> str:
    parts = []
    for i, c in enumerate(list(LI)[-5:][::-1], 1):
        if LI[c] not in ("bigint", "int", "double"):
            continue
        features = ",".join([f for f in LI if f != c][:6])
        parts.append(
            f"""SELECT * FROM (SELECT {i} AS rank, '{c}' AS column_name, {100 - 5 * i} AS importance_score,
            CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary classification' WHEN count(DISTINCT {c}) <= 10
            THEN 'multi-class classification' ELSE 'regression' END AS problem_type, count(DISTINCT {c}) AS distinct_count,
            '{features}' AS suggested_features FROM lineitem) WHERE distinct_count > 1"""
        )
    return union_all(parts)


def _code(c: str, kind: str, table: str) -> str:
    """The value as text; numbers and dates of more than 20 values as deciles."""
    if kind == "string":
        return f"coalesce({c}, '?') AS {c}"
    x = f"epoch_us({c})::DOUBLE" if kind == "timestamp_ntz" else f"{c}::DOUBLE"
    edges = " + ".join(f"CAST({x} > (SELECT quantile_cont({x}, {i / 10}) FROM {table}) AS INTEGER)" for i in range(1, 10))
    return f"CASE WHEN (SELECT count(DISTINCT {c}) FROM {table}) > 20 THEN CAST({edges} AS VARCHAR) ELSE CAST({x} AS VARCHAR) END AS {c}"


def _pairs(table: str, kinds: dict[str, str]) -> str:
    """Mutual information over the smaller entropy for every pair of columns of a table."""
    names = list(kinds)
    coded = "coded AS MATERIALIZED (SELECT " + ", ".join(_code(c, t, table) for c, t in kinds.items()) + f" FROM {table})"
    single = "single AS (" + union_all(
        [f"SELECT '{c}' AS c, sum(n * log2(n)) AS s FROM (SELECT count(*) AS n FROM coded GROUP BY {c})" for c in names]
    ) + ")"
    joint = "joint AS (" + union_all(
        [
            f"""SELECT '{a}' AS a, '{b}' AS b, sum(n * log2(n)) AS s, sum(n)::DOUBLE AS t
            FROM (SELECT count(*) AS n FROM coded GROUP BY {a}, {b})"""
            for i, a in enumerate(names)
            for b in names[i + 1 :]
        ]
    ) + ")"
    value = """pairs AS (SELECT a, b, round(CASE WHEN h > 1e-9 THEN greatest(0.0, (log2(t) + (s - sa - sb) / t) / h) ELSE 0.0 END, 4)
        AS association FROM (SELECT a, b, t, joint.s AS s, x.s AS sa, y.s AS sb, least(log2(t) - x.s / t, log2(t) - y.s / t) AS h
        FROM joint JOIN single x ON a = x.c JOIN single y ON b = y.c))"""
    both = "both_ways AS (SELECT a AS column_name, b AS partner, association FROM pairs UNION ALL SELECT b, a, association FROM pairs)"
    return ", ".join([coded, single, joint, value, both])


def _facts(table: str, kinds: dict[str, str]) -> str:
    return union_all(
        [
            f"""SELECT '{c}' AS column_name, {i} AS ordinal, {t in ('bigint', 'int', 'double')} AS number,
            {t in ('bigint', 'int')} AS whole, count(*)::DOUBLE AS total, count({c}) AS filled, count(DISTINCT {c}) AS u FROM {table}"""
            for i, (c, t) in enumerate(kinds.items())
        ]
    )


_PART = TABLE_COLUMNS["part"] | {"p_first": "string"}
_PART_SQL = "(SELECT *, split_part(p_name, ' ', 1) AS p_first FROM part)"


def _ranking(table: str, kinds: dict[str, str]) -> str:
    return f"""WITH {_pairs(table, kinds)}, facts AS ({_facts(table, kinds)}),
        placed AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY association DESC, partner) AS place
            FROM both_ways WHERE association <= 0.99),
        strongest AS (SELECT column_name, avg(association) FILTER (WHERE place <= 3) AS top3, max(association) AS best,
            string_agg(partner, ',' ORDER BY place) FILTER (WHERE place <= 6) AS suggested_features FROM placed GROUP BY 1),
        leaks AS (SELECT column_name, string_agg(partner, ',' ORDER BY partner) AS leakage FROM both_ways
            WHERE association > 0.99 GROUP BY 1),
        scored AS (SELECT f.column_name, ordinal, CAST(round(100 * (0.35 * coalesce(top3, 0.0)
            + 0.25 * CASE WHEN u BETWEEN 2 AND 20 THEN 1.0 WHEN number THEN 0.7 ELSE 0.3 END
            + 0.25 * (filled / total) + 0.15 * (ordinal + 1) / {len(kinds)}), 0) AS INTEGER) AS importance_score,
            CASE WHEN number AND u > 20 THEN 'regression' WHEN u = 2 THEN 'binary_classification'
            ELSE 'multiclass_classification' END AS problem_type,
            CASE WHEN coalesce(best, 0.0) >= 0.5 THEN 'HIGH' WHEN coalesce(best, 0.0) >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END
            AS predictability, coalesce(suggested_features, '') AS suggested_features, coalesce(leakage, '') AS leakage
            FROM facts f LEFT JOIN strongest s ON f.column_name = s.column_name LEFT JOIN leaks l ON f.column_name = l.column_name
            WHERE filled / total >= 0.5 AND u >= 2 AND NOT ((NOT number OR whole) AND u / total > 0.95))
        SELECT * EXCLUDE (ordinal) FROM (SELECT *, CAST(row_number() OVER (ORDER BY importance_score DESC, ordinal DESC) AS INTEGER)
            AS rank FROM scored) WHERE rank <= 5"""


SQL = {
    "infer_problem_type": union_all([_problem(c, t) for c, t in LI.items()]),
    "class_distribution": _distribution("events", "event_type"),
    "class_distribution_nulls": _distribution(LI_NULLS, "l_returnflag"),
    "class_balance": _balance("labels", "quality"),
    "class_balance_nulls": _balance(LI_NULLS, "l_returnflag"),
    "regression_target_stats": f"SELECT *, {_SHAPE} AS distribution_shape FROM {_regression('events', 'value')}",
    "distribution_shape": union_all(
        [f"SELECT '{c}' AS column_name, {_SHAPE} AS shape FROM {_regression('events', c)}" for c in numeric_of("events")]
    ),
    "supervised_profile": f"""SELECT 'o_orderstatus' AS target_column, 'multiclass_classification' AS problem_type, *
        FROM ({_balance('orders', 'o_orderstatus')})""",
    "supervised_profile_regression": f"""SELECT 'o_totalprice' AS target_column, 'regression' AS problem_type, *,
        {_SHAPE} AS distribution_shape FROM {_regression('orders', 'o_totalprice')}""",
    "target_candidates": _candidates(),
    "associations": f"WITH {_pairs('orders', ORDERS)} SELECT * FROM both_ways",
    "target_quality_rank": _ranking("orders", ORDERS),
    "associations_lineitem": f"WITH {_pairs('lineitem', LI)} SELECT * FROM both_ways",
    "target_quality_rank_lineitem": _ranking("lineitem", LI),
    "associations_part": f"WITH {_pairs(_PART_SQL, _PART)} SELECT * FROM both_ways",
    "target_quality_rank_part": _ranking(_PART_SQL, _PART),
}
