"""Metrics on fixed predictions, and the models themselves."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from registry.common import read
from tablescope.operators import evaluate, features, models
from tablescope.plans.training import cross_validate, prepare, train_and_evaluate


def _binary(spark, sf):
    """Events as predictions: is it an error, scored by its value."""
    return read(spark, sf, "events").select(
        F.when(F.col("event_id") % 5 == 0, "test").otherwise("train").alias("split"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        (F.col("value") > 60).cast("int").alias("prediction"),
        F.col("value").alias("score"),
    )


_BINARY = """(SELECT CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CAST(event_type = 'error' AS INTEGER) AS label, CAST(value > 60 AS INTEGER) AS prediction, value AS score FROM events)"""


def _three(spark, sf):
    """Orders as three-class predictions: the status guessed from the price."""
    price = F.col("o_totalprice")
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return read(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias("split"),
        label.alias("label"),
        F.when(price < 150000, 0).when(price < 320000, 1).otherwise(2).alias("prediction"),
        F.array(F.round(price / 1000), F.round(F.abs(price - 250000) / 1000), F.col("o_custkey").cast("double")).alias("scores"),
    )


_THREE = """(SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
    CASE WHEN o_totalprice < 150000 THEN 0 WHEN o_totalprice < 320000 THEN 1 ELSE 2 END AS prediction,
    round(o_totalprice / 1000) AS s0, round(abs(o_totalprice - 250000) / 1000) AS s1, o_custkey::DOUBLE AS s2 FROM orders)"""


def _rounded(frame, *names, digits=6):
    return frame.withColumns({n: F.round(n, digits) for n in names})


def _documents(spark, sf):
    labels = read(spark, sf, "labels")
    return read(spark, sf, "documents").join(labels, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "toxic", "quality"
    )


def _train_documents(model_type, **parameters):
    def run(spark, sf):
        trained = train_and_evaluate(
            _documents(spark, sf), "quality", model_type, "documents", keys=["doc_id"], **parameters
        )
        return trained.summary.drop("analysis_id", "created_at")

    return run


def _train_orders(model_type, **parameters):
    """Three classes: priority and price against the order status."""
    def run(spark, sf):
        df = read(spark, sf, "orders")
        trained = train_and_evaluate(df, "o_orderstatus", model_type, "orders", keys=["o_orderkey"], **parameters)
        return trained.summary.drop("analysis_id", "created_at")

    return run


def _fit(spark, sf, model_type, trainer):
    prepared = prepare(_documents(spark, sf), "quality", model_type, ["doc_id"])
    return trainer(prepared.frame, prepared.plan.features, prepared.plan.n_classes), prepared.frame


def _score(spark, sf):
    trained, frame = _fit(spark, sf, "logistic_regression", models.train_logistic)
    return models.score(trained, frame).select("split", "label", "prediction", F.col("scores")[1].alias("p1"))


def _tree_structure(spark, sf):
    trained, _ = _fit(spark, sf, "decision_tree", models.train_tree)
    facts = models.tree_structure(trained)
    return spark.createDataFrame([(facts["tree_depth"], facts["n_leaves"])], "tree_depth int, n_leaves int")


def _importance(model_type, trainer):
    def run(spark, sf):
        trained, frame = _fit(spark, sf, model_type, trainer)
        return models.feature_importance(trained, frame)

    return run


def _flagged(spark, sf, target):
    """lineitem with three features and a target column."""
    return read(spark, sf, "lineitem").select(
        "l_linenumber", "l_quantity", "l_linestatus", F.expr(target).alias("target")
    )


_TWO = "CASE WHEN l_quantity > 24 THEN 1 ELSE 0 END"
_THREE_SIZES = "CASE WHEN l_quantity > 33 THEN 2 WHEN l_quantity > 16 THEN 1 ELSE 0 END"
_NOISY = "CASE WHEN (l_quantity > 24) <> (l_orderkey % 10 = 0) THEN 1 ELSE 0 END"


def _on_split(target, model_type, trainer, **parameters):
    """Trained on the training side; predictions of all rows counted by the deciding feature."""
    def run(spark, sf):
        prepared = prepare(_flagged(spark, sf, target), "target", model_type)
        trained = trainer(prepared.frame, prepared.plan.features, prepared.plan.n_classes, **parameters)
        scored = models.score(trained, prepared.frame.withColumn("x", vector_to_array("features")[1]))
        return scored.groupBy(F.col("x").alias("l_quantity"), F.col("prediction").cast("int").alias("prediction")).count()

    return run


def _logistic_predictions(spark, sf):
    prepared = prepare(_flagged(spark, sf, "l_linestatus"), "target", "logistic_regression")
    trained = models.train_logistic(prepared.frame, prepared.plan.features, prepared.plan.n_classes)
    scored = models.score(trained, prepared.frame)
    label = F.element_at(F.array(*[F.lit(v) for v in prepared.plan.labels]), (F.col("label") + 1).cast("int"))
    found = F.element_at(F.array(*[F.lit(v) for v in prepared.plan.labels]), (F.col("prediction") + 1).cast("int"))
    return scored.groupBy(label.alias("l_linestatus"), found.alias("predicted")).count()


def _all_train(spark, sf, target):
    """All rows on the training side, features unscaled."""
    df = read(spark, sf, "lineitem").select("l_quantity", F.expr(target).alias("target"))
    plan = features.fit_features(df, "target")
    packed = features.assemble_features(features.apply_features(df.withColumn("quantity", F.col("l_quantity")), plan, ["quantity"]), plan)
    return packed.withColumn("split", F.lit("train")), plan


def _first_round(target, depth):
    """Class scores after one round: starts, gradients, Hessians and leaf weights, to nine digits."""
    def run(spark, sf):
        frame, plan = _all_train(spark, sf, target)
        trained = models.train_boosting(frame, plan.features, plan.n_classes, n_estimators=1, max_depth=depth)
        scored = models.score(trained, frame)
        shown = [F.round(F.col("scores")[k], 9).alias(f"score{k}") for k in range(plan.n_classes)]
        return scored.select(F.col("quantity").alias("l_quantity"), *shown).distinct()

    return run


def _node_size_rule(spark, sf):
    """Nations in classes of 10, 14 and 1: the last two share a node of 15, split only if that many are enough."""
    key = F.col("n_nationkey")
    df = read(spark, sf, "nation").select(key.alias("key"), F.when(key < 10, "a").when(key < 24, "b").otherwise("c").alias("target"))
    plan = features.fit_features(df, "target")
    frame = features.assemble_features(features.apply_features(df.withColumn("id", F.col("key")), plan, ["id"]), plan).withColumn("split", F.lit("train"))
    made = []
    for least in (15, 16):
        trained = models.train_tree(frame, plan.features, plan.n_classes, min_samples_split=least)
        made.append(models.score(trained, frame).select(F.col("id").alias("n_nationkey"), F.lit(least).alias("min_samples_split"), F.col("prediction").cast("int").alias("prediction")))
    return made[0].unionByName(made[1])


def _structure_of_sizes(spark, sf):
    prepared = prepare(_flagged(spark, sf, _THREE_SIZES), "target", "decision_tree")
    trained = models.train_tree(prepared.frame, prepared.plan.features, prepared.plan.n_classes)
    facts = models.tree_structure(trained)
    importance = models.feature_importance(trained, prepared.frame)
    return importance.select("feature", F.round("importance", 9).alias("importance"), F.lit(facts["tree_depth"]).alias("tree_depth"), F.lit(facts["n_leaves"]).alias("n_leaves"))


def _out_of_fold(spark, sf):
    """Every line once, in the fold of its order, scored by a tree that saw no line of that order."""
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr(_THREE_SIZES).alias("target"))
    done = cross_validate(df, "target", "decision_tree", ["l_orderkey"], folds=4, keep=["l_orderkey", "l_linenumber"])
    return done.scored.select("fold", "l_orderkey", "l_linenumber", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


def _out_of_fold_metrics(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr(_THREE_SIZES).alias("target"))
    done = cross_validate(df, "target", "gradient_boosting", ["l_orderkey"], folds=4, n_estimators=3, max_depth=2)
    return done.metrics.select("fold", "rows", "accuracy", "precision", "recall", "f1")


def _first_coefficient(spark, sf):
    """The feature that decides has the largest coefficient, with the sign of its codes."""
    prepared = prepare(_flagged(spark, sf, "l_linestatus"), "target", "logistic_regression")
    trained = models.train_logistic(prepared.frame, prepared.plan.features, prepared.plan.n_classes)
    importance = models.feature_importance(trained, prepared.frame)
    return importance.orderBy(F.desc("importance")).limit(1).select("feature", (F.col("coefficient") > 0).alias("raises"), (F.abs("coefficient") == F.col("importance")).alias("same_size"))


def _gap(spark, sf):
    sides = evaluate.accuracy(_binary(spark, sf), ["split"])
    wide = sides.agg(
        F.max(F.when(F.col("split") == "train", F.col("accuracy"))).alias("train_accuracy"),
        F.max(F.when(F.col("split") == "test", F.col("accuracy"))).alias("test_accuracy"),
    )
    return _rounded(evaluate.overfit_gap(wide), "accuracy_gap", "train_accuracy", "test_accuracy")


def _top_features(spark, sf):
    importance = read(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(
        F.round(F.avg("p_retailprice"), 4).alias("importance")
    )
    return evaluate.top_features(importance)


QUERIES = {
    "accuracy": lambda spark, sf: _rounded(evaluate.accuracy(_binary(spark, sf), ["split"]), "accuracy"),
    "precision_recall_f1_binary": lambda spark, sf: _rounded(
        evaluate.precision_recall_f1(_binary(spark, sf), 2, ["split"]), "precision", "recall", "f1"
    ),
    "precision_recall_f1_weighted": lambda spark, sf: _rounded(
        evaluate.precision_recall_f1(_three(spark, sf), 3, ["split"]), "precision", "recall", "f1"
    ),
    "confusion_matrix": lambda spark, sf: evaluate.confusion_matrix(_three(spark, sf), 3),
    "roc_auc_binary": lambda spark, sf: _rounded(evaluate.roc_auc_binary(_binary(spark, sf), ["split"]), "roc_auc"),
    "roc_auc_ovr": lambda spark, sf: _rounded(evaluate.roc_auc_ovr(_three(spark, sf), 3), "roc_auc"),
    "class_labels": lambda spark, sf: evaluate.class_labels(_three(spark, sf)),
    "overfit_gap": _gap,
    "top_features": _top_features,
    "train_logistic": _train_documents("logistic_regression"),
    "train_tree": _train_documents("decision_tree"),
    "train_boosting": _train_documents("gradient_boosting"),
    "train_logistic_multiclass": _train_orders("logistic_regression"),
    "train_tree_multiclass": _train_orders("decision_tree"),
    "train_boosting_multiclass": _train_orders("gradient_boosting"),
    "boosting_two_classes": _on_split(_TWO, "gradient_boosting", models.train_boosting, n_estimators=5, max_depth=2),
    "boosting_three_classes": _on_split(_THREE_SIZES, "gradient_boosting", models.train_boosting, n_estimators=5, max_depth=2),
    "boosting_first_round": _first_round(_NOISY, 1),
    "boosting_first_softmax_round": _first_round(_THREE_SIZES, 2),
    "tree_three_classes": _on_split(_THREE_SIZES, "decision_tree", models.train_tree),
    "tree_node_size_rule": _node_size_rule,
    "tree_structure_importance": _structure_of_sizes,
    "logistic_predictions": _logistic_predictions,
    "coef_importance_first": _first_coefficient,
    "out_of_fold_scores": _out_of_fold,
    "out_of_fold_metrics": _out_of_fold_metrics,
    "score": _score,
    "tree_structure": _tree_structure,
    "coef_importance": _importance("logistic_regression", models.train_logistic),
    "tree_importance": _importance("decision_tree", models.train_tree),
}


def _class_metrics(source: str) -> str:
    return f"""(SELECT split, k, support, CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS p,
        CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS r,
        CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (support + predicted) END AS f FROM (
        SELECT split, k, count(*) FILTER (WHERE label = k) AS support, count(*) FILTER (WHERE prediction = k) AS predicted,
        count(*) FILTER (WHERE label = k AND prediction = k) AS tp
        FROM {source}, (SELECT unnest([0, 1, 2]) AS k) GROUP BY split, k))"""


def _auc(source: str, positive: str, score: str, by: str = "1") -> str:
    """Mid-rank form of the area under the curve."""
    return f"""(SELECT {by} AS g, (sum(pos * mid) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos)::DOUBLE * sum(neg)) AS auc, sum(pos) AS pos
        FROM (SELECT *, sum(pos + neg) OVER (PARTITION BY {by} ORDER BY s) - (pos + neg) + (pos + neg + 1) / 2.0 AS mid FROM (
        SELECT {by} AS {'split' if by == 'split' else 'one'}, {score} AS s, count(*) FILTER (WHERE {positive}) AS pos,
        count(*) FILTER (WHERE NOT ({positive})) AS neg FROM {source} GROUP BY ALL)) GROUP BY ALL)"""


_SIZES = f"SELECT l_quantity::DOUBLE AS l_quantity, {_THREE_SIZES} AS prediction, count(*) AS count FROM lineitem GROUP BY ALL"

_FOLD = "CAST(floor(CAST('0x' || substring(md5('42-' || l_orderkey), 1, 13) AS BIGINT)::DOUBLE * 4 / 4503599627370496) AS INTEGER)"

SQL = {
    "out_of_fold_scores": f"SELECT {_FOLD} AS fold, l_orderkey, l_linenumber, {_THREE_SIZES} AS label, {_THREE_SIZES} AS prediction FROM lineitem",
    "out_of_fold_metrics": f"""SELECT {_FOLD} AS fold, count(*) AS rows, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS "precision", 1.0::DOUBLE AS recall,
        1.0::DOUBLE AS f1 FROM lineitem GROUP BY 1""",
    "accuracy": f"SELECT split, round(avg(CAST(label = prediction AS INTEGER)), 6) AS accuracy FROM {_BINARY} GROUP BY split",
    "precision_recall_f1_binary": f"""SELECT split, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1
        FROM {_class_metrics(_BINARY)} WHERE k = 1""",
    "precision_recall_f1_weighted": f"""SELECT split, round(sum(p * support) / sum(support), 6) AS "precision",
        round(sum(r * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(support), 6) AS f1
        FROM {_class_metrics(_THREE)} GROUP BY split""",
    "confusion_matrix": f"""SELECT CAST(l AS BIGINT) AS label, p AS prediction, count(label) AS count
        FROM (SELECT unnest([0, 1, 2]) AS l) CROSS JOIN (SELECT unnest([0, 1, 2]) AS p)
        LEFT JOIN {_THREE} t ON t.label = l AND t.prediction = p GROUP BY l, p""",
    "roc_auc_binary": f"SELECT g AS split, round(auc, 6) AS roc_auc FROM {_auc(_BINARY, 'label = 1', 'score', 'split')}",
    "roc_auc_ovr": "SELECT round(sum(auc * pos) / sum(pos), 6) AS roc_auc FROM ("
    + " UNION ALL ".join(f"SELECT auc, pos FROM {_auc(_THREE, f'label = {k}', f's{k}')}" for k in range(3)) + ")",
    "boosting_two_classes": f"SELECT l_quantity::DOUBLE AS l_quantity, {_TWO} AS prediction, count(*) AS count FROM lineitem GROUP BY ALL",
    "boosting_three_classes": _SIZES,
    "tree_three_classes": _SIZES,
    "boosting_first_round": f"""WITH d AS (SELECT l_quantity, l_quantity > 24 AS side, {_NOISY} AS y FROM lineitem),
        s AS (SELECT 4 * (avg(y) - 0.5) AS start FROM d), p AS (SELECT start, 1 / (1 + exp(-start)) AS p FROM s),
        w AS (SELECT side, -0.3 * sum(p - y) / (sum(p * (1 - p)) + 1) AS w FROM d, p GROUP BY side)
        SELECT DISTINCT l_quantity::DOUBLE AS l_quantity, round(1 - 1 / (1 + exp(-start - w)), 9) AS score0,
        round(1 / (1 + exp(-start - w)), 9) AS score1 FROM d JOIN w USING (side), p""",
    "boosting_first_softmax_round": f"""WITH d AS (SELECT l_quantity, {_THREE_SIZES} AS y FROM lineitem),
        k AS (SELECT unnest([0, 1, 2]) AS k), r AS (SELECT unnest([0, 1, 2]) AS region),
        w AS (SELECT r.region, k.k, -0.3 * sum(1.0 / 3 - CAST(y = k AS INTEGER)) / (count(*) * 4.0 / 9 + 1) AS w FROM r, k, d
            WHERE CASE k.k WHEN 0 THEN (y = 0) = (r.region = 0) WHEN 1 THEN y = r.region ELSE (y = 2) = (r.region = 2) END GROUP BY ALL),
        e AS (SELECT region, sum(exp(w)) AS total, max(exp(w)) FILTER (WHERE k = 0) AS e0, max(exp(w)) FILTER (WHERE k = 1) AS e1,
            max(exp(w)) FILTER (WHERE k = 2) AS e2 FROM w GROUP BY region)
        SELECT DISTINCT l_quantity::DOUBLE AS l_quantity, round(e0 / total, 9) AS score0, round(e1 / total, 9) AS score1, round(e2 / total, 9) AS score2
        FROM d JOIN e ON region = y""",
    "tree_node_size_rule": """SELECT n_nationkey, least AS min_samples_split, CASE WHEN n_nationkey < 10 THEN 0
        WHEN n_nationkey < 24 OR least = 16 THEN 1 ELSE 2 END AS prediction FROM nation, (SELECT unnest([15, 16]) AS least)""",
    "tree_structure_importance": """SELECT feature, CASE feature WHEN 'l_quantity' THEN 1.0::DOUBLE ELSE 0.0 END AS importance, 2 AS tree_depth, 3 AS n_leaves
        FROM (SELECT unnest(['l_linenumber', 'l_quantity', 'l_linestatus']) AS feature)""",
    "logistic_predictions": "SELECT l_linestatus, l_linestatus AS predicted, count(*) AS count FROM lineitem GROUP BY ALL",
    "coef_importance_first": "SELECT 'l_linestatus' AS feature, TRUE AS raises, TRUE AS same_size",
    "class_labels": f"SELECT DISTINCT label FROM {_THREE} WHERE split = 'train'",
    "overfit_gap": f"""SELECT round(train, 6) AS train_accuracy, round(test, 6) AS test_accuracy, round(train - test, 6) AS accuracy_gap,
        train - test > 0.10 AS overfitting, train - test > 0.15 AS severe_overfitting FROM (
        SELECT avg(CAST(label = prediction AS INTEGER)) FILTER (WHERE split = 'train') AS train,
        avg(CAST(label = prediction AS INTEGER)) FILTER (WHERE split = 'test') AS test FROM {_BINARY})""",
    "top_features": """SELECT p_brand AS feature, round(avg(p_retailprice), 4) AS importance FROM part GROUP BY 1
        ORDER BY importance DESC, feature LIMIT 5""",
}
