"""Feature preparation and the stratified split."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from registry.common import LI_NULLS, li_nulls, read
from tablescope.operators import features, split
from tablescope.plans.training import prepare

SPARSE = """(SELECT l_orderkey, CASE WHEN l_orderkey % 10 >= 6 THEN l_partkey END AS l_partkey, l_linenumber,
    l_quantity, CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS l_discount, nullif(l_returnflag, 'R') AS l_returnflag,
    nullif(l_linestatus, 'O') AS l_linestatus, l_shipdate, CAST(l_suppkey AS VARCHAR) AS supplier FROM lineitem)"""


def _sparse(spark, sf):
    """lineitem with a mostly empty column, gaps, a date and a text key."""
    return li_nulls(spark, sf).select(
        "l_orderkey",
        F.when(F.col("l_orderkey") % 10 >= 6, F.col("l_partkey")).alias("l_partkey"),
        "l_linenumber",
        "l_quantity",
        "l_discount",
        "l_returnflag",
        F.nullif("l_linestatus", F.lit("O")).alias("l_linestatus"),
        "l_shipdate",
        F.col("l_suppkey").cast("string").alias("supplier"),
    )


def _decisions(spark, sf):
    df = _sparse(spark, sf)
    return features.column_decisions(df, features.fit_features(df, "l_returnflag", 50))


def _report(spark, sf):
    df = _sparse(spark, sf)
    report = features.preprocessing_report(df, features.fit_features(df, "l_returnflag", 50))
    return report.withColumns({"dropped_columns": F.size("dropped_columns"), "encoded_columns": F.size("encoded_columns")})


def _label_encode(spark, sf):
    df = li_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return features.label_encode(df, features.category_values(df, ["l_returnflag", "l_linestatus"]))


def _median_impute(spark, sf):
    df = li_nulls(spark, sf).select("l_orderkey", "l_partkey", "l_linenumber", "l_discount")
    return features.median_impute(df, ["l_discount"])[0]


def _nan_discount(spark, sf):
    """lineitem with NaN and infinity in place of some discounts."""
    value = (
        F.when(F.col("l_orderkey") % 7 == 0, F.lit(float("nan")))
        .when(F.col("l_orderkey") % 7 == 1, F.lit(float("inf")))
        .otherwise(F.col("l_discount"))
    )
    return read(spark, sf, "lineitem").withColumn("l_discount", value)


def _median_impute_nan(spark, sf):
    df = _nan_discount(spark, sf).select("l_orderkey", "l_partkey", "l_linenumber", "l_discount")
    return features.median_impute(df, ["l_discount"])[0]


def _column_decisions_nan(spark, sf):
    mostly = F.when(F.col("l_orderkey") % 10 < 6, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    df = _nan_discount(spark, sf).withColumn("l_tax", mostly).select("l_linenumber", "l_discount", "l_tax", "l_returnflag")
    return features.column_decisions(df, features.fit_features(df, "l_returnflag", 50))


def _prepare_reserved_names(spark, sf):
    """Features that go by the names of the preparation's own columns."""
    names = {"l_quantity": "label", "l_linenumber": "split", "l_discount": "features", "l_tax": "a.b", "l_linestatus": "row_key"}
    df = _nan_discount(spark, sf).select("l_orderkey", "l_returnflag", *[F.col(c).alias(n) for c, n in names.items()])
    prepared = prepare(df, "l_returnflag", "decision_tree")
    array = vector_to_array("features")
    values = [F.round(array[i], 6).alias(n.replace(".", "_")) for i, n in enumerate(prepared.plan.features)]
    return prepared.frame.select(F.col("label").cast("int").alias("target"), *values)


def _standard_scale(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    scaled = features.standard_scale(df, features.scaling_of(df, ["l_quantity", "l_extendedprice"]))
    return scaled.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice")})


def _encode_target(spark, sf):
    df = li_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag")
    plan = features.fit_features(df, "l_returnflag")
    return features.apply_features(df, plan).select("l_orderkey", "l_linenumber", F.col("label").cast("int").alias("label"))


def _quantile_bin3(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    plan = features.fit_features(df, "o_totalprice")
    binned = features.quantile_bin3(F.col("o_totalprice"), plan.edges)
    labelled = features.apply_features(df, plan, ["o_totalprice"])
    return labelled.select("o_orderkey", binned.alias("bin"), F.col("label").cast("int").alias("label"))


def _documents(spark, sf):
    """Labelled documents: a join of the two given tables on their key."""
    labels = read(spark, sf, "labels")
    return read(spark, sf, "documents").join(labels, "doc_id").select("doc_id", "lang", "source", "n_chars", "quality")


def _assembled(spark, sf):
    df = _documents(spark, sf)
    plan = features.fit_features(df, "quality", scale=True)
    frame = df.withColumn("id", F.col("doc_id"))
    packed = features.assemble_features(features.apply_features(frame, plan, ["id"]), plan)
    array = vector_to_array("features")
    return packed.select(
        "id", F.col("label").cast("int").alias("label"), *[F.round(array[i], 6).alias(f) for i, f in enumerate(plan.features)]
    )


def _split(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified_split(df, "o_orderstatus", ["o_orderkey"])


QUERIES = {
    "median_impute_nan": _median_impute_nan,
    "column_decisions_nan": _column_decisions_nan,
    "prepare_reserved_names": _prepare_reserved_names,
    "drop_null_target": lambda spark, sf: features.drop_null_target(
        li_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag"
    ),
    "column_decisions": _decisions,
    "preprocessing_report": _report,
    "label_encode": _label_encode,
    "median_impute": _median_impute,
    "standard_scale": _standard_scale,
    "encode_target": _encode_target,
    "target_policy": lambda spark, sf: features.target_policy(read(spark, sf, "lineitem")),
    "quantile_bin3": _quantile_bin3,
    "assemble_features": _assembled,
    "stratified_split": _split,
    "hash_split": lambda spark, sf: split.hash_split(
        read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]
    ),
}

_KINDS = {
    "l_orderkey": "numeric", "l_partkey": "numeric", "l_linenumber": "numeric", "l_quantity": "numeric",
    "l_discount": "numeric", "l_linestatus": "text", "l_shipdate": "datetime", "supplier": "text",
}
_NO_NAN = "(SELECT * REPLACE (CASE WHEN l_orderkey % 7 > 1 THEN l_discount END AS l_discount) FROM lineitem)"
_USED = f"(SELECT * FROM {SPARSE} WHERE l_returnflag IS NOT NULL)"


def _decision(c: str, kind: str) -> str:
    rest = {
        "numeric": "'numeric'",
        "datetime": "'datetime'",
        "text": f"CASE WHEN count(DISTINCT {c}) > 50 THEN 'high_cardinality' ELSE 'encoded' END",
    }[kind]
    return f"""SELECT '{c}' AS column_name, CASE WHEN count(*) - count({c}) > 0.5 * count(*) THEN 'sparse' ELSE {rest} END
        AS decision FROM {_USED}"""


_DECISIONS = "\nUNION ALL ".join(_decision(c, k) for c, k in _KINDS.items())
_GAPS = " + ".join(
    f"""(SELECT CASE WHEN count(*) - count({c}) > 0.5 * count(*) THEN 0 ELSE count(*) - count({c}) END FROM {_USED})"""
    for c, k in _KINDS.items()
    if k == "numeric"
)
_POLICY = """CASE WHEN count(DISTINCT {c}) <= 10 THEN 'numeric_categorical' WHEN count(DISTINCT {c}) > 50
    THEN 'continuous_to_3_classes' ELSE 'numeric_as_is' END"""
_LI_KINDS = {
    "l_orderkey": 1, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1, "l_extendedprice": 1,
    "l_discount": 1, "l_tax": 1, "l_returnflag": 0, "l_linestatus": 0, "l_shipdate": 0,
}
_DOCS = "(SELECT doc_id, lang, source, n_chars, quality FROM documents JOIN labels USING (doc_id))"

SQL = {
    "drop_null_target": f"SELECT l_orderkey, l_linenumber, l_returnflag FROM {LI_NULLS} WHERE l_returnflag IS NOT NULL",
    "column_decisions": _DECISIONS,
    "preprocessing_report": f"""WITH d AS ({_DECISIONS}) SELECT (SELECT count(*) FROM lineitem) AS original_rows,
        8 AS original_features, CAST(count(*) FILTER (WHERE decision NOT IN ('numeric', 'encoded')) AS INTEGER) AS dropped_columns,
        CAST(count(*) FILTER (WHERE decision = 'encoded') AS INTEGER) AS encoded_columns, {_GAPS} AS missing_values_handled,
        (SELECT count(*) FROM {SPARSE} WHERE l_returnflag IS NULL) AS rows_dropped, 'categorical_encoded' AS target_conversion,
        (SELECT count(*) FROM {_USED}) AS final_rows,
        CAST(count(*) FILTER (WHERE decision IN ('numeric', 'encoded')) AS INTEGER) AS final_features FROM d""",
    "label_encode": f"""SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus,
        dense_rank() OVER (ORDER BY coalesce(l_returnflag, 'MISSING')) - 1 AS l_returnflag_code,
        dense_rank() OVER (ORDER BY coalesce(l_linestatus, 'MISSING')) - 1 AS l_linestatus_code FROM {LI_NULLS}""",
    "median_impute_nan": f"""SELECT l_orderkey, l_partkey, l_linenumber,
        coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {_NO_NAN})) AS l_discount FROM {_NO_NAN}""",
    "column_decisions_nan": """SELECT 'l_linenumber' AS column_name, 'numeric' AS decision UNION ALL
        SELECT 'l_discount', CASE WHEN avg(CAST(l_orderkey % 7 <= 1 AS INTEGER)) > 0.5 THEN 'sparse' ELSE 'numeric' END FROM lineitem UNION ALL
        SELECT 'l_tax', CASE WHEN avg(CAST(l_orderkey % 10 < 6 AS INTEGER)) > 0.5 THEN 'sparse' ELSE 'numeric' END FROM lineitem""",
    "prepare_reserved_names": f"""SELECT CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS target,
        round(CAST(l_orderkey AS DOUBLE), 6) AS l_orderkey, round(l_quantity, 6) AS label, round(CAST(l_linenumber AS DOUBLE), 6) AS split,
        round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {_NO_NAN})), 6) AS features, round(l_tax, 6) AS a_b,
        round(CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS DOUBLE), 6) AS row_key FROM {_NO_NAN}""",
    "median_impute": f"""SELECT l_orderkey, l_partkey, l_linenumber,
        coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM {LI_NULLS})) AS l_discount FROM {LI_NULLS}""",
    "standard_scale": """SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) AS l_quantity,
        round((l_extendedprice - mp) / sp, 6) AS l_extendedprice FROM lineitem, (SELECT avg(l_quantity) AS mq,
        stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp FROM lineitem)""",
    "encode_target": f"""SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS label
        FROM {LI_NULLS} WHERE l_returnflag IS NOT NULL""",
    "target_policy": "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_count, "
        + (_POLICY.replace("{c}", c) if number else "'categorical_encoded'") + " AS target_policy FROM lineitem"
        for c, number in _LI_KINDS.items()
    ),
    "quantile_bin3": """SELECT o_orderkey, bin, CASE bin WHEN 'High' THEN 0 WHEN 'Low' THEN 1 ELSE 2 END AS label FROM (
        SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 'Low' WHEN o_totalprice <= b THEN 'Medium' ELSE 'High' END AS bin
        FROM orders, (SELECT quantile_cont(o_totalprice, 1.0 / 3) AS a, quantile_cont(o_totalprice, 2.0 / 3) AS b FROM orders))""",
    "assemble_features": f"""WITH coded AS (SELECT doc_id AS id, doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS lang,
        dense_rank() OVER (ORDER BY source) - 1 AS source, n_chars, dense_rank() OVER (ORDER BY quality) - 1 AS label FROM {_DOCS})
        SELECT id, CAST(label AS INTEGER) AS label, """
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM coded)) / (SELECT stddev_pop({c}) FROM coded), 6) AS {c}"
        for c in ("doc_id", "lang", "source", "n_chars")
    )
    + " FROM coded",
    "stratified_split": """WITH classes AS (SELECT o_orderstatus AS c, count(*) AS n FROM orders GROUP BY 1),
        totals AS (SELECT sum(n) AS t, sum(n) - ceil(0.2 * sum(n)) AS n_train FROM classes),
        shares AS (SELECT c, floor(n_train * n / t) AS whole, n_train * n / t - floor(n_train * n / t) AS part, n_train
            FROM classes, totals),
        quotas AS (SELECT c, whole + CASE WHEN row_number() OVER (ORDER BY part DESC, c)
            <= n_train - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM shares)
        SELECT o_orderkey, o_orderstatus, CASE WHEN place <= quota THEN 'train' ELSE 'test' END AS split FROM (
            SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus
            ORDER BY substring(md5('42-' || o_orderkey), 1, 13)) AS place FROM orders) JOIN quotas ON o_orderstatus = c""",
    "hash_split": """SELECT l_orderkey, l_linenumber, CASE WHEN CAST('0x' || substring(md5('42-' || l_orderkey || '-' || l_linenumber), 1, 13)
        AS BIGINT) < 0.8 * 4503599627370496 THEN 'train' ELSE 'test' END AS split FROM lineitem""",
}
