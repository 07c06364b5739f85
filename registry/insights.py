"""Result store and rule-based insights over run histories derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.common import fresh_name, li_nulls, read, scratch, union_all
from tablescope.functions import json_value
from tablescope.operators.tables import basic_profile
from tablescope import schema as S
from tablescope.plans import analysis, insights
from tablescope.plans.analysis import profile_and_store
from tablescope.plans.profile import column_profile
from tablescope.plans.report_texts import MEASURES, NEXT_STEPS, section_texts
from tablescope.plans.training import train_and_evaluate
from tablescope.sources import results, workspace

# One training run per line item: family from the flag, scores from the amounts.
RUNS = """(SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
    CAST(l_suppkey AS VARCHAR)) AS analysis_id, concat('table_', CAST(l_partkey % 50 AS VARCHAR)) AS table_name,
    CASE l_returnflag WHEN 'A' THEN 'logistic_regression' WHEN 'N' THEN 'decision_tree' ELSE 'gradient_boosting' END AS model_type,
    0.6E0 + 4 * l_discount AS test_accuracy, 0.6E0 + 4 * l_discount + 2 * l_tax AS train_accuracy,
    l_quantity / 50 AS test_precision, l_quantity / 60 AS test_recall, l_tax * 10 AS test_f1_score,
    CASE WHEN l_linenumber < 7 THEN 0.5E0 + l_quantity / 100 END AS test_roc_auc, CAST(l_quantity AS INTEGER) AS tree_depth,
    l_linenumber AS n_classes, 1000 AS original_rows, l_suppkey AS missing_values_handled, 10 AS original_features,
    l_linenumber AS dropped_columns, CASE WHEN l_linestatus = 'O' THEN 'continuous_to_3_classes (Low, Medium, High)'
    ELSE 'categorical_encoded' END AS target_conversion, l_shipdate AS created_at FROM lineitem)"""

# One analysis per order, one profiled column per line item.
SUMMARIES = """(SELECT concat('a', CAST(o_orderkey AS VARCHAR)) AS analysis_id, concat('table_', CAST(o_custkey % 60 AS VARCHAR)) AS table_name,
    o_orderkey AS total_rows, 6 AS total_columns, round(o_totalprice / 50000, 2) AS duplicate_percentage,
    CAST(NULL AS VARCHAR) AS target_column, CAST(NULL AS VARCHAR) AS problem_type, o_orderdate AS created_at FROM orders)"""
STATS = """(SELECT concat('a', CAST(l_orderkey AS VARCHAR)) AS analysis_id,
    concat_ws('_', 'c', CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS column_name,
    l_returnflag AS data_type, l_quantity AS null_percentage, l_suppkey AS unique_count, l_extendedprice AS mean_value FROM lineitem)"""
FEATURES = """(SELECT concat('table_', CAST(p_size AS VARCHAR)) AS table_name, min(p_name) AS feature FROM part GROUP BY p_size)"""
CURRENT = """(SELECT concat('k', CAST(o_custkey AS VARCHAR)) AS key, CAST(o_orderkey AS VARCHAR) AS value, o_orderdate AS updated_at FROM orders)"""
CHANGES = """(SELECT concat('k', CAST(user_id AS VARCHAR)) AS key, concat(event_type, CAST(event_id AS VARCHAR)) AS value, ts AS updated_at FROM events)"""


def _frame(spark, sf, text: str):
    """The frame a definition above describes: the same text in Spark SQL, over the files."""
    text = text.replace("VARCHAR", "STRING")
    for name in ("lineitem", "orders", "part", "events"):
        text = text.replace(f"FROM {name}", f"FROM parquet.`{sf}/{name}.parquet`")
    return spark.sql(f"SELECT * FROM {text}")


def _runs(spark, sf):
    return _frame(spark, sf, RUNS)


def _latest(spark, sf):
    return insights.latest_models(_runs(spark, sf))


def _summaries(spark, sf):
    return _frame(spark, sf, SUMMARIES)


def _stats(spark, sf):
    return _frame(spark, sf, STATS)


def _quality(spark, sf):
    newest = results.newest_per(_summaries(spark, sf), ["table_name"])
    return insights.data_quality(newest, _stats(spark, sf), 20.0)


def _available(spark, sf):
    tables = _frame(spark, sf, "(SELECT DISTINCT concat('table_', CAST(o_custkey % 70 AS VARCHAR)) AS table_name FROM orders)")
    found = insights.insights_available(tables, _summaries(spark, sf), _runs(spark, sf))
    listed = F.transform("models", lambda m: F.concat(m["model_type"], F.lit("="), F.format_string("%.4f", m["test_accuracy"])))
    return found.withColumn("models", F.array_join(listed, ","))


def _feature_ranking(spark, sf):
    importance = read(spark, sf, "part").groupBy(F.col("p_type").alias("model_type"), F.col("p_brand").alias("feature")).agg(
        F.round(F.avg("p_retailprice"), 4).alias("importance")
    )
    return insights.feature_ranking(importance, ["model_type"])


def _selected(spark, sf):
    return results.with_selected_target(_summaries(spark, sf), "table_7", "price", "regression").select(
        "analysis_id", "table_name", "target_column", "problem_type"
    )


def _deleted(spark, sf):
    """Delete an analysis from a stored result table and show what is left."""
    namespace = workspace.workflow_namespace(workspace.create_workflow(spark))
    results.append_results(_summaries(spark, sf), namespace, "workflow_eda_summary")
    results.append_results(_stats(spark, sf), namespace, "workflow_eda_column_stats")
    results.delete_analysis(spark, namespace, "a7")
    left = spark.table(f"{namespace}.workflow_eda_column_stats")
    return left.groupBy("data_type").agg(F.count(F.lit(1)).alias("n"))


def _save_column_stats(spark, sf):
    namespace = workspace.workflow_namespace(workspace.create_workflow(spark))
    stats = column_profile(read(spark, sf, "orders")).withColumn("analysis_id", F.lit("a"))
    results.save_column_stats(stats, namespace)
    return results.get_column_stats(spark.table(f"{namespace}.workflow_eda_column_stats"), "a").select(
        "column_name", "total_count", "unique_count", "mode_value"
    )


def _stored_runs(spark, sf):
    """Model summaries written to the store and read back."""
    namespace = workspace.workflow_namespace(workspace.create_workflow(spark))
    results.save_model_summary(_runs(spark, sf).drop("target_conversion", "original_rows", "missing_values_handled", "original_features", "dropped_columns"), namespace)
    return spark.table(f"{namespace}.workflow_model_summary").select("analysis_id", "table_name", "model_type", "test_accuracy", "train_accuracy", "tree_depth")


def _result_tables(spark, sf):
    """Rows of every result table after storing a profile, and whether the tables exist before and after dropping them."""
    namespace = workspace.workflow_namespace(workspace.create_workflow(spark))
    profile_and_store(read(spark, sf, "orders"), namespace, "orders", "o_orderstatus")
    rows = [(t, workspace.table_exists(spark, namespace, t)[0], spark.table(f"{namespace}.{t}").count()) for t in S.RESULT_TABLES]
    dropped = set(results.drop_result_tables(spark, namespace, confirm=True))
    rows = [(*r, r[0] in dropped, workspace.table_exists(spark, namespace, r[0])[0]) for r in rows]
    return spark.createDataFrame(rows, "result_table string, created boolean, stored_rows bigint, dropped boolean, left boolean")


def _model_summary_row(spark, sf):
    """The stored row of a run whose classes follow from one feature."""
    size = F.when(F.col("l_quantity") > 33, 2).when(F.col("l_quantity") > 16, 1).otherwise(0)
    df = read(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_linestatus", size.alias("size"))
    row = train_and_evaluate(df, "size", "decision_tree", "lineitem", "w", "multiclass_classification").summary
    matrix = F.col("confusion_matrix")
    return row.select(
        "workflow_id", "table_name", "target_variable", "model_type", "problem_type", "test_accuracy", "test_precision", "test_recall", "test_f1_score",
        "test_roc_auc", "train_accuracy", "tree_depth", "n_leaves", "max_depth", "total_samples", "total_features", "n_classes",
        F.array_join("class_labels", ",").alias("class_labels"), F.get("top_features", F.lit(0))["feature"].alias("top_feature"),
        *[F.get(F.get(matrix, F.lit(i)), F.lit(j)).alias(f"m{i}{j}") for i in range(3) for j in range(3) if i != j],
        F.array_join("preprocessing_details.encoded_columns", ",").alias("encoded_columns"), F.array_join("recommendations", ",").alias("codes"),
    )


def _report(spark, sf):
    """Everything end to end on the labelled documents: load, profile, train, report."""
    labels = read(spark, sf, "labels")
    rows = read(spark, sf, "documents").join(labels, "doc_id").select("doc_id", "lang", "source", "n_chars", "toxic", "quality")
    path = scratch(spark, "documents-csv")
    rows.write.option("header", True).csv(path)
    loaded = analysis.upload(spark, path, fresh_name("run"))
    analysis.train_all(spark, loaded["workflow_id"], loaded["table_name"], "quality", ["doc_id"])
    return analysis.report(spark, loaded["workflow_id"], loaded["table_name"]).drop("workflow_id", "table_name", "generated_at")


QUERIES = {
    "model_recommendations": lambda spark, sf: insights.model_recommendations(_runs(spark, sf)).drop("position", "recommendation"),
    "latest_models": _latest,
    "latest_profile": lambda spark, sf: insights.latest_profile(_summaries(spark, sf), _stats(spark, sf), "table_7"),
    "best_model": lambda spark, sf: insights.best_model(_latest(spark, sf)).select("table_name", "model_type", "test_accuracy"),
    "metrics_comparison": lambda spark, sf: insights.metrics_comparison(_latest(spark, sf)),
    "model_ranking": lambda spark, sf: insights.model_ranking(_latest(spark, sf)),
    "data_quality": lambda spark, sf: insights.data_quality(_summaries(spark, sf), _stats(spark, sf)),
    "key_findings": lambda spark, sf: insights.key_findings(
        _latest(spark, sf), _quality(spark, sf), _frame(spark, sf, FEATURES)
    ).select("table_name", "code", "subject", F.round("value", 6).alias("value")),
    "report_recommendations": lambda spark, sf: insights.report_recommendations(
        insights.best_model(_latest(spark, sf))
    ).select("table_name", "code"),
    "column_summary": lambda spark, sf: insights.column_summary(
        insights.latest_profile(_summaries(spark, sf), _stats(spark, sf), "table_7")
    ),
    "feature_ranking": _feature_ranking,
    "confusion_eligibility": lambda spark, sf: insights.confusion_eligibility(_runs(spark, sf)),
    "insights_available": _available,
    "report_document": _report,
    "report_texts": lambda spark, sf: section_texts(_summaries(spark, sf), _runs(spark, sf)),
    "save_model_summary": _stored_runs,
    "result_tables_life": _result_tables,
    "model_summary_row": _model_summary_row,
    "get_summary": lambda spark, sf: results.get_summary(_summaries(spark, sf), "a7"),
    "get_column_stats": lambda spark, sf: results.get_column_stats(_stats(spark, sf), "a7"),
    "latest_analysis": lambda spark, sf: results.latest_analysis(_summaries(spark, sf), "table_7"),
    "list_analyses": lambda spark, sf: results.list_analyses(_summaries(spark, sf), "table_7", 10),
    "list_model_results": lambda spark, sf: results.list_model_results(_runs(spark, sf), "decision_tree", "table_7"),
    "select_target": _selected,
    "merge_metadata": lambda spark, sf: results.merge_metadata(_frame(spark, sf, CURRENT), _frame(spark, sf, CHANGES)),
    "delete_analysis": _deleted,
    "save_column_stats": _save_column_stats,
    "encode_variant": lambda spark, sf: li_nulls(spark, sf).select(
        "l_orderkey", "l_linenumber", json_value(F.col("l_returnflag")).alias("flag"), json_value(F.col("l_partkey")).alias("part")
    ),
}


def _newest(source: str, keys: str) -> str:
    return f"""(SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
        ORDER BY created_at DESC, analysis_id DESC) AS place FROM {source}) WHERE place = 1)"""


_LATEST = _newest(RUNS, "table_name, model_type")
_NEWEST = _newest(SUMMARIES, "table_name")
_FAMILY = "CASE model_type WHEN 'logistic_regression' THEN 1 WHEN 'decision_tree' THEN 2 ELSE 3 END"
_PLACED = f"""(SELECT *, CAST(row_number() OVER (PARTITION BY table_name ORDER BY test_accuracy DESC NULLS LAST, {_FAMILY}) AS INTEGER)
    AS place FROM {_LATEST})"""
_BEST = f"(SELECT * FROM {_PLACED} WHERE place = 1)"
_GAP = "train_accuracy - test_accuracy"
_RULES = {
    "low_accuracy": "test_accuracy < 0.7E0",
    "overfitting": f"{_GAP} > 0.1E0",
    "deep_tree": "model_type = 'decision_tree' AND tree_depth > 20",
    "severe_overfitting": f"model_type = 'gradient_boosting' AND {_GAP} > 0.15E0",
    "many_missing": "missing_values_handled > original_rows * 0.1E0",
    "many_dropped": "dropped_columns > original_features * 0.3E0",
    "excellent": f"model_type = 'gradient_boosting' AND test_accuracy > 0.95E0 AND {_GAP} < 0.05E0",
}
_ANY_RULE = " OR ".join(f"({r})" for r in _RULES.values())
_REPORT_RULES = [
    ("improve_features", "test_accuracy < 0.7E0"), ("try_other_models", "test_accuracy < 0.7E0"),
    ("plan_deployment", "test_accuracy > 0.95E0"), ("compare_live", "test_accuracy > 0.95E0"),
    ("reduce_overfitting", f"{_GAP} > 0.1E0"), ("cross_validate", f"{_GAP} > 0.1E0"), ("check_classes", "n_classes > 2"),
    ("monitor", "TRUE"), ("document", "TRUE"), ("retrain", "TRUE"),
]
_PROFILE = f"""(SELECT s.*, t.table_name FROM {STATS} s JOIN {_NEWEST} t ON s.analysis_id = t.analysis_id
    WHERE t.table_name = 'table_7' ORDER BY null_percentage, unique_count DESC NULLS LAST, column_name LIMIT 20)"""
_SPREAD = f"(SELECT table_name, count(*) AS n, max(test_accuracy) - min(test_accuracy) AS spread FROM {_LATEST} GROUP BY 1)"


def _sparse(threshold: int) -> str:
    return f"""(SELECT analysis_id, count(*) FILTER (WHERE null_percentage > {threshold}) AS sparse_columns FROM {STATS} GROUP BY 1)"""


_QUALITY = f"""(SELECT t.analysis_id, t.table_name, duplicate_percentage, coalesce(sparse_columns, 0) AS sparse_columns
    FROM {_NEWEST} t LEFT JOIN {_sparse(20)} s ON t.analysis_id = s.analysis_id)"""
_METRICS = {
    "accuracy": "test_accuracy", "precision": "test_precision", "recall": "test_recall", "f1_score": "test_f1_score",
    "roc_auc": "test_roc_auc",
}
_HAS_TABLES = f"(SELECT DISTINCT table_name FROM (SELECT table_name FROM {_LATEST} UNION ALL SELECT table_name FROM {_NEWEST}))"

def _texts() -> str:
    """All sentences, section by section, in the words of the operator."""
    pct = "printf('%.1f%%', {c} * 100)".replace("{c}", "{}")
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    compared = f"(SELECT table_name, string_agg(model_type, ', ' ORDER BY {_FAMILY}) AS names, count(*) AS n FROM {_LATEST} GROUP BY table_name)"
    first = f"(SELECT * FROM {_LATEST} QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY {_FAMILY}) = 1)"
    parts = [
        ("dataset", 0, "size", "'Table ' || table_name || ' has ' || total_rows || ' rows and ' || total_columns || ' columns.'", _NEWEST),
        ("dataset", 1, "target", "'It is used to predict ' || target_column || '.'", _NEWEST),
        ("dataset", 2, "duplicates", "CASE WHEN duplicate_percentage > 0 THEN printf('%.2f%% of its rows repeat another row.', duplicate_percentage) END", _NEWEST),
        ("preprocessing", 0, "imputed", "missing_values_handled || ' missing cells were filled with the median of their column.'", first),
        ("preprocessing", 1, "dropped", "dropped_columns || ' columns were left out: mostly empty, too many values, or of a kind that can''t be used.'", first),
        ("preprocessing", 2, "target", "'The target was prepared as ' || target_conversion || '.'", first),
        ("preprocessing", 3, "scaled", "'Text columns became codes; features were scaled for logistic regression.'", first),
        ("performance", 0, "models", "n || ' models were compared: ' || names || '.'", compared),
        ("performance", 1, "best", f"model_type || ' is the most accurate, with ' || {pct.format('test_accuracy')} || ' of the test rows right.'", _BEST),
        ("performance", 2, "detail", f"'Its precision is ' || {pct.format('test_precision')} || ', its recall ' || {pct.format('test_recall')} || ', its F1 score ' || {pct.format('test_f1_score')} || '.'", _BEST),
        ("performance", 3, "order", "CASE WHEN test_roc_auc IS NOT NULL THEN printf('Its area under the ROC curve is %.4f.', test_roc_auc) END", _BEST),
        ("explainability", 0, "measures", quoted(MEASURES), compared),
        ("conclusion", 0, "summary", f"'The best model is ' || model_type || ' with an accuracy of ' || {pct.format('test_accuracy')} || '.'", _BEST),
        ("conclusion", 1, "fit", "CASE WHEN train_accuracy - test_accuracy > 0.10 THEN 'It fits the training rows much better than others, which should be mended first.' ELSE 'It does about as well on rows it has not seen.' END", _BEST),
        *[("next_steps", i, code, quoted(text), _BEST) for i, (code, text) in enumerate(NEXT_STEPS.items())],
    ]
    rows = [f"SELECT table_name, '{section}' AS section, {i} AS position, '{code}' AS code, {text} AS text FROM {source}" for section, i, code, text, source in parts]
    return "SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE text IS NOT NULL"


SQL = {
    "report_texts": _texts(),
    "save_model_summary": f"SELECT analysis_id, table_name, model_type, test_accuracy, train_accuracy, tree_depth FROM {RUNS}",
    "result_tables_life": """SELECT result_table, TRUE AS created, stored_rows, TRUE AS dropped, FALSE AS left FROM (
        SELECT 'workflow_metadata' AS result_table, 0 AS stored_rows UNION ALL SELECT 'workflow_eda_summary', 1
        UNION ALL SELECT 'workflow_eda_column_stats', count(*) FROM information_schema.columns WHERE table_name = 'orders'
        UNION ALL SELECT 'workflow_target_stats', 1 UNION ALL SELECT 'workflow_target_classes', count(DISTINCT o_orderstatus) FROM orders
        UNION ALL SELECT 'workflow_model_summary', 0)""",
    "model_summary_row": """SELECT 'w' AS workflow_id, 'lineitem' AS table_name, 'size' AS target_variable, 'decision_tree' AS model_type,
        'multiclass_classification' AS problem_type, 1.0::DOUBLE AS test_accuracy, 1.0::DOUBLE AS test_precision, 1.0::DOUBLE AS test_recall,
        1.0::DOUBLE AS test_f1_score, 1.0::DOUBLE AS test_roc_auc, 1.0::DOUBLE AS train_accuracy, 2 AS tree_depth, 3 AS n_leaves, 10 AS max_depth,
        count(*) AS total_samples, 3 AS total_features, 3 AS n_classes, '0,1,2' AS class_labels, 'l_quantity' AS top_feature,
        0 AS m01, 0 AS m02, 0 AS m10, 0 AS m12, 0 AS m20, 0 AS m21, 'l_linestatus' AS encoded_columns, 'good' AS codes FROM lineitem""",
    "model_recommendations": union_all(
        [f"SELECT analysis_id, model_type, '{code}' AS code FROM {RUNS} WHERE {rule}" for code, rule in _RULES.items()]
        + [f"SELECT analysis_id, model_type, 'good' AS code FROM {RUNS} WHERE NOT ({_ANY_RULE})"]
    ),
    "latest_models": f"SELECT * FROM {_LATEST}",
    "latest_profile": f"SELECT * FROM {_PROFILE}",
    "best_model": f"SELECT table_name, model_type, test_accuracy FROM {_BEST}",
    "metrics_comparison": "SELECT table_name, model_type, "
    + ", ".join(f"CASE WHEN {c} <> 0 THEN printf('%.4f', {c}) ELSE 'N/A' END AS \"{n}\"" for n, c in _METRICS.items())
    + f" FROM {_LATEST}",
    "model_ranking": f"SELECT table_name, place, model_type, test_accuracy FROM {_PLACED}",
    "data_quality": f"""SELECT t.analysis_id, t.table_name, duplicate_percentage, coalesce(sparse_columns, 0) AS sparse_columns
        FROM {SUMMARIES} t LEFT JOIN {_sparse(10)} s ON t.analysis_id = s.analysis_id""",
    "key_findings": union_all(
        [
            f"SELECT table_name, 'best_model' AS code, model_type AS subject, round(test_accuracy, 6) AS value FROM {_BEST}",
            f"SELECT table_name, 'strong_auc', model_type, round(test_roc_auc, 6) FROM {_BEST} WHERE test_roc_auc > 0.9E0",
            f"SELECT table_name, 'models_agree', NULL, round(spread, 6) FROM {_SPREAD} WHERE n > 1 AND spread < 0.05E0",
            f"SELECT table_name, 'models_differ', NULL, round(spread, 6) FROM {_SPREAD} WHERE n > 1 AND spread >= 0.05E0",
            f"SELECT table_name, 'duplicates', NULL, duplicate_percentage FROM {_QUALITY} WHERE duplicate_percentage > 5",
            f"SELECT table_name, 'sparse_columns', NULL, sparse_columns::DOUBLE FROM {_QUALITY} WHERE sparse_columns > 0",
            f"SELECT f.table_name, 'top_feature', feature, NULL FROM {FEATURES} f JOIN {_HAS_TABLES} t ON f.table_name = t.table_name",
        ]
    ),
    "report_recommendations": union_all(
        [f"SELECT table_name, '{code}' AS code FROM {_BEST} WHERE {rule}" for code, rule in _REPORT_RULES]
    ),
    "column_summary": f"""SELECT column_name, data_type, printf('%.2f%%', null_percentage) AS null_share, unique_count,
        printf('%.4f', mean_value) AS mean FROM {_PROFILE}
        ORDER BY null_percentage, unique_count DESC NULLS LAST, column_name LIMIT 15""",
    "feature_ranking": """SELECT model_type, rank, feature, printf('%.6f', importance) AS importance FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY model_type ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM (
        SELECT p_type AS model_type, p_brand AS feature, round(avg(p_retailprice), 4) AS importance FROM part GROUP BY 1, 2))
        WHERE rank <= 10""",
    "confusion_eligibility": f"""SELECT analysis_id, model_type, n_classes,
        n_classes BETWEEN 2 AND 20 AND target_conversion NOT LIKE 'continuous_to%' AS show_matrix FROM {RUNS}""",
    "insights_available": f"""SELECT t.table_name, s.table_name IS NOT NULL AS eda_available, coalesce(n, 0) AS models_available,
        s.table_name IS NOT NULL OR coalesce(n, 0) > 0 AS ready_for_insights, models
        FROM (SELECT DISTINCT concat('table_', CAST(o_custkey % 70 AS VARCHAR)) AS table_name FROM orders) t
        LEFT JOIN (SELECT DISTINCT table_name FROM {SUMMARIES}) s ON t.table_name = s.table_name
        LEFT JOIN (SELECT table_name, count(*) AS n, string_agg(model_type || '=' || printf('%.4f', test_accuracy), ',' ORDER BY model_type) AS models
            FROM {_LATEST} GROUP BY 1) m ON t.table_name = m.table_name""",
    "get_summary": f"SELECT * FROM {SUMMARIES} WHERE analysis_id = 'a7'",
    "get_column_stats": f"SELECT * FROM {STATS} WHERE analysis_id = 'a7'",
    "latest_analysis": f"SELECT * FROM {SUMMARIES} WHERE table_name = 'table_7' ORDER BY created_at DESC, analysis_id DESC LIMIT 1",
    "list_analyses": f"SELECT * FROM {SUMMARIES} WHERE table_name = 'table_7' ORDER BY created_at DESC, analysis_id DESC LIMIT 10",
    "list_model_results": f"SELECT * FROM {RUNS} WHERE table_name = 'table_7' AND model_type = 'decision_tree'",
    "select_target": f"""SELECT analysis_id, table_name, CASE WHEN table_name = 'table_7' THEN 'price' END AS target_column,
        CASE WHEN table_name = 'table_7' THEN 'regression' END AS problem_type FROM {SUMMARIES}""",
    "merge_metadata": f"""SELECT key, value, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY key
        ORDER BY updated_at DESC, fresh DESC, value DESC) AS place FROM (SELECT *, 0 AS fresh FROM {CURRENT}
        UNION ALL SELECT *, 1 AS fresh FROM {CHANGES})) WHERE place = 1""",
    "delete_analysis": f"SELECT data_type, count(*) AS n FROM {STATS} WHERE analysis_id <> 'a7' GROUP BY 1",
    "save_column_stats": union_all(
        [
            f"""SELECT '{c}' AS column_name, (SELECT count(*) FROM orders) AS total_count,
            (SELECT count(DISTINCT {c}) FROM orders) AS unique_count, CASE WHEN {keep} THEN
            (SELECT {show} FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, v LIMIT 1) END AS mode_value"""
            for c, show, keep in [
                ("o_orderkey", "CAST(v AS VARCHAR)", "TRUE"), ("o_custkey", "CAST(v AS VARCHAR)", "TRUE"),
                ("o_orderstatus", "v", "TRUE"), ("o_orderpriority", "v", "TRUE"),
                ("o_orderdate", "CAST(v AS VARCHAR)", "(SELECT count(DISTINCT o_orderdate) FROM orders) <= 100"),
                ("o_totalprice", """CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END""", "TRUE"),
            ]
        ]
    ),
    "encode_variant": """SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'R') AS flag, CAST(l_partkey AS VARCHAR) AS part
        FROM lineitem""",
}
