"""Features, split, training and evaluation."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators import evaluate, features, lookup, models, split, trees
from tablescope.operators.ordering import dense_codes, totals_before
from tablescope.plans.training import cross_validate, prepare, prepare_each, train_and_evaluate


def learnable(spark, n=600):
    """A binary target that follows two of the features."""
    x = F.col("id")
    return spark.range(n).select(
        x.alias("row"),
        (x % 17).cast("double").alias("a"),
        F.when(x % 10 != 0, (x % 7).cast("double")).alias("b"),
        F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), (x % 3 + 1).cast("int")).alias("colour"),
        F.when((x % 17) + (x % 7) > 11, "yes").otherwise("no").alias("target"),
    )


def test_label_codes_follow_string_order(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "s string")
    values = features.category_values(df, ["s"])
    assert values == {"s": ["MISSING", "a", "b", "c"]}
    coded = {r["s"]: r["s_code"] for r in features.label_encode(df, values).collect()}
    assert coded == {None: 0, "a": 1, "b": 2, "c": 3}


def test_fit_features_decisions(spark):
    rows = [(i, None if i < 6 else 1.0, None if i == 0 else float(i), f"name{i}", i % 2 == 0, "t") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, sparse double, gap double, name string, flag boolean, y string")
    df = df.withColumn("at", F.current_timestamp()).withColumn("list", F.array("id"))
    plan = features.fit_features(df, "y", max_categories=5)
    assert plan.decisions == {
        "id": "numeric", "gap": "numeric", "flag": "numeric", "sparse": "sparse", "name": "high_cardinality",
        "at": "datetime", "list": "unsupported",
    }
    assert plan.medians == {"gap": 5.0} and plan.missing_values_handled == 1


def test_tertiles(spark):
    df = spark.range(1, 61).select(F.col("id").cast("double").alias("y"), F.lit(1.0).alias("x"))
    plan = features.fit_features(df, "y")
    assert plan.edges == pytest.approx((20.6667, 40.3333), abs=1e-3)
    counts = features.apply_features(df, plan).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in counts} == {0.0: 20, 1.0: 20, 2.0: 20}
    hot = df.withColumn("y", F.when(F.col("y") < 40, 1.0).otherwise(F.col("y") * 1000))
    with pytest.raises(features.DegenerateBins):
        features.tertile_edges(hot, "y")


def test_scaling_from_statistics_equals_the_scaled_columns(spark):
    """Means and deviations after encoding and imputing come from counts and moments, not from another pass."""
    rng = np.random.default_rng(6)
    rows = [
        (i, None if i % 4 == 0 else float(rng.normal(1e6, 3)), [None, "x", "y", "zz"][i % 4] if i % 3 else "x", i % 2 == 0, None if i % 5 == 0 else i % 3 == 0, 7.0, ["p", "q", None][i % 3])
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, "id int, gap double, text string, flag boolean, holes boolean, same double, y string")
    for fit_on in (None, F.col("id") < 300):
        plan = features.fit_features(df, "y", 50, scale=True, fit_on=fit_on)
        used = df if fit_on is None else df.where(fit_on)
        direct = features.scaling_of(features.feature_columns(features.drop_null_target(used, "y"), plan), plan.features)
        assert list(plan.scaling) == plan.features == list(direct)
        for c in plan.features:
            assert plan.scaling[c] == pytest.approx(direct[c], rel=1e-9, abs=1e-9), c


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    rows = features.standard_scale(df, features.scaling_of(df, ["x", "c"])).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_numeric_classes_are_reindexed(spark):
    df = spark.createDataFrame([(v, 1.0) for v in (10, 2, 30, 2)], "y int, x double")
    plan = features.fit_features(df, "y")
    assert plan.labels == ["2", "10", "30"] and plan.target_conversion == "numeric_categorical (3 classes)"
    assert sorted(r["label"] for r in features.apply_features(df, plan).collect()) == [0.0, 0.0, 1.0, 2.0]


def test_split_is_exact_and_stable(spark):
    df = spark.range(1003).withColumn("y", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 2)))
    done = split.stratified_split(df, "y", ["id"])
    assert done.count() == 1003 and done.where("split = 'train'").count() == 802
    for r in done.groupBy("y").agg(F.avg((F.col("split") == "train").cast("int")).alias("share")).collect():
        assert abs(r["share"] - 0.8) < 0.01
    again = split.stratified_split(df.repartition(13), "y", ["id"])
    assert done.exceptAll(again).isEmpty()


def test_split_with_copies_of_one_key(spark):
    """A third of the rows are copies: the quota still holds to the row."""
    df = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("y"))
    done = split.stratified_split(df, "y", ["k"])
    assert done.where("split = 'train'").count() == 720
    assert {r["count"] for r in done.where("split = 'train'").groupBy("y").count().collect()} == {360}
    same = df.withColumn("k", F.lit(1))
    assert split.stratified_split(same, "y", ["k"]).where("split = 'train'").count() == 720


def test_split_with_many_classes(spark):
    df = spark.range(3000).withColumn("y", F.col("id") % 300)
    done = split.stratified_split(df, "y", ["id"])
    assert {r["count"] for r in done.where("split = 'train'").groupBy("y").count().collect()} == {8}


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_split_of_many_classes_with_one_shared_key(spark, monkeypatch, broadcast):
    """300 classes, one of a third of all rows, and a key that every class shares in many copies."""
    monkeypatch.setattr(lookup, "MOST_BROADCAST", broadcast)
    df = spark.range(12_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 300).alias("y"),
        F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("row"),
    ).repartition(11)
    done = split.stratified_split(df, "y", ["k"])
    assert done.columns == ["y", "k", "row", "split"] and done.select("row").distinct().count() == done.count() == 12_000
    sizes = {r["y"]: (r["n"], r["t"]) for r in done.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("t")).collect()}
    assert sum(t for _, t in sizes.values()) == 9600
    assert all(abs(t - 0.8 * n) < 1 for n, t in sizes.values())
    # every row below the cut of its class trains, every row above it doesn't
    value = split.row_hash(["k"], 42)
    edges = done.withColumn("h", value).groupBy("y").agg(F.max(F.when(F.col("split") == "train", F.col("h"))).alias("a"), F.min(F.when(F.col("split") == "test", F.col("h"))).alias("b"))
    assert edges.where("a > b").isEmpty()


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_twenty_thousand_classes_are_encoded_and_evaluated_like_three(spark, monkeypatch, broadcast):
    monkeypatch.setattr(lookup, "MOST_BROADCAST", broadcast)
    for classes in (3, 20_000):
        df = spark.range(60_000).select((F.col("id") * 1.0).alias("x"), F.format_string("c%05d", F.col("id") % classes).alias("y"))
        plan = features.fit_features(df, "y")
        assert plan.n_classes == classes and (plan.labels is None) == (classes > features.LABELS_SHOWN)
        coded = features.apply_features(df, plan, ["y"])
        assert coded.where("label <> cast(substring(y, 2, 5) AS double)").isEmpty() and coded.count() == 60_000
        scored = coded.withColumn("prediction", F.when(F.col("x") % 5 == 0, 0.0).otherwise(F.col("label")))
        row = evaluate.precision_recall_f1(scored, classes).first()
        share = scored.where("prediction = label").count() / 60_000
        assert row["recall"] == pytest.approx(share)
    assert evaluate.confusion_counts(scored).count() < 2 * 20_000


def test_codes_by_table_equal_codes_by_list(spark, monkeypatch):
    df = spark.createDataFrame([("b", True, 1), ("a", None, 2), (None, False, 3), ("c", True, 4), ("a", True, 5)], "s string, t boolean, i int")
    values = features.category_values(df, ["s", "t"])
    by_list = sorted(map(tuple, features.label_encode(df, values).collect()), key=repr)
    for broadcast in (50_000, 0):
        monkeypatch.setattr(lookup, "MOST_BROADCAST", broadcast)
        table = features.label_encode_by_table(df, ["s", "t"])
        assert table.columns == ["s", "t", "i", "s_code", "t_code"] and sorted(map(tuple, table.collect()), key=repr) == by_list
    monkeypatch.setattr(features, "MOST_VALUES", 2)
    with pytest.raises(ValueError, match="distinct values"):
        features.category_values(df, ["s"])


def test_quotas_round_up_the_largest_remainders(spark):
    counts = spark.createDataFrame([("a", 7), ("b", 5), ("c", 5), ("d", 3)], "class string, rows bigint")
    got = {r["class"]: r["quota"] for r in split.train_quotas(counts, 0.3)[0].collect()}
    assert got == {"a": 5, "b": 4, "c": 3, "d": 2}
    for rows in ([("a", 2), ("b", 1)], [("a", 2), ("b", 2)], []):
        with pytest.raises(ValueError):
            split.train_quotas(spark.createDataFrame(rows, "class string, rows bigint"), 0.2)


def test_split_needs_two_rows_per_class(spark):
    with pytest.raises(ValueError, match="two rows"):
        split.stratified_split(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, y string"), "y", ["id"])


def test_totals_before(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 1), ("a", 3, 1), (None, 9, 4), (None, 8, 2)], "g string, o int, v int")
    got = {(r["g"], r["o"]): r["t"] for r in totals_before(df, ["o"], {"t": F.col("v")}, within=["g"]).collect()}
    assert got == {("a", 1): 0, ("a", 2): 5, ("a", 3): 12, ("b", 1): 0, (None, 8): 0, (None, 9): 2}
    codes = dense_codes(spark.range(1000).select((F.col("id") % 100).cast("string").alias("s")), "s").collect()
    assert [r["s"] for r in sorted(codes, key=lambda r: r["code"])] == sorted(str(i) for i in range(100))


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.5), (1, 1, 0.5), (1, 1, 0.9)], "label int, prediction int, score double")
    assert evaluate.accuracy(df).first()[0] == 0.75
    row = evaluate.precision_recall_f1(df, 2).first()
    assert (row["precision"], row["recall"], row["f1"]) == (pytest.approx(2 / 3), 1.0, pytest.approx(0.8))
    assert evaluate.roc_auc_binary(df).first()["roc_auc"] == 0.875
    flipped = df.withColumn("score", 1 - F.col("score"))
    assert evaluate.roc_auc_binary(flipped).first()["roc_auc"] == 0.125
    matrix = {(r["label"], r["prediction"]): r["count"] for r in evaluate.confusion_matrix(df, 2).collect()}
    assert matrix == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    one_class = df.where("label = 1")
    assert evaluate.roc_auc_binary(one_class).first()["roc_auc"] is None


def test_auc_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    label, score = rng.integers(0, 2, 400), rng.integers(0, 40, 400) / 40
    df = spark.createDataFrame(list(zip(map(int, label), map(float, score))), "label int, score double")
    pos, neg = score[label == 1], score[label == 0]
    pairs = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert evaluate.roc_auc_binary(df.repartition(7)).first()["roc_auc"] == pytest.approx(pairs)


def test_logistic_equals_newton(spark):
    """L2 with inverse strength 1 on the summed loss, intercept not penalised."""
    prepared = prepare(learnable(spark), "target", "logistic_regression", ["row"])
    trained = models.train_logistic(prepared.frame, prepared.plan.features, 2)
    rows = prepared.frame.where("split = 'train'").collect()
    x = np.array([r["features"].toArray() for r in rows])
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.array([r["label"] for r in rows])
    w, penalty = np.zeros(x.shape[1]), np.eye(x.shape[1])
    penalty[-1, -1] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
    assert np.allclose(trained.model.coefficients.toArray(), w[:-1], atol=1e-3)


@pytest.mark.parametrize(
    "model_type, parameters",
    [("logistic_regression", {}), ("decision_tree", {}), ("gradient_boosting", {"n_estimators": 5, "max_depth": 3})],
)
def test_models_beat_the_majority(spark, model_type, parameters):
    run = train_and_evaluate(learnable(spark), "target", model_type, "t", "w", keys=["row"], **parameters)
    row = run.summary.first()
    assert row["test_accuracy"] > 0.8 and row["test_roc_auc"] > 0.85
    assert sum(map(sum, row["confusion_matrix"])) == 120
    assert row["preprocessing_details"]["encoded_columns"] == ["colour"]
    assert row["preprocessing_details"]["missing_values_handled"] == 60
    assert row["recommendations"] and row["class_labels"] == ["no", "yes"]
    assert {r["feature"] for r in run.importance.orderBy(F.desc("importance")).limit(2).collect()} == {"a", "b"}


def test_boosting_with_three_classes(spark):
    df = learnable(spark, 300).withColumn("target", F.col("a").cast("int") % 3).withColumn("hint", F.col("target") * 1.0)
    run = train_and_evaluate(df, "target", "gradient_boosting", keys=["row"], n_estimators=2, max_depth=2)
    row = run.summary.first()
    assert row["n_classes"] == 3 and row["test_accuracy"] > 0.9
    assert all(abs(sum(r["scores"]) - 1) < 1e-9 for r in run.scored.collect())


def test_fit_on_train_only(spark):
    both = [prepare(learnable(spark), "target", "logistic_regression", ["row"], fit_on=f) for f in ("all", "train")]
    assert both[0].frame.count() == both[1].frame.count() == 600
    assert both[0].plan.scaling != both[1].plan.scaling


def test_names_of_features_never_meet_own_columns(spark):
    """A random feature called label is a feature, not the target."""
    rng = np.random.default_rng(11)
    names = ["label", "split", "features", "a.b", "row_key", "prediction"]
    rows = [(i, int(rng.integers(0, 2)), *map(float, rng.normal(size=6))) for i in range(600)]
    rows[5] = (5, 1, float("nan"), *rows[5][3:])
    df = spark.createDataFrame(rows, ["row", "target", *names])
    run = train_and_evaluate(df.drop("row"), "target", "logistic_regression")
    assert run.summary.first()["test_accuracy"] < 0.65
    assert {r["feature"] for r in run.importance.collect()} == set(names)


def test_fit_on_train_keeps_rows_of_repeated_keys(spark):
    df = learnable(spark).withColumn("row", F.col("row") % 40)
    both = {f: prepare(df, "target", "logistic_regression", ["row"], fit_on=f).frame for f in ("all", "train")}
    assert both["all"].count() == both["train"].count() == 600
    sides = [f.groupBy("label", "split").count().orderBy("label", "split").collect() for f in both.values()]
    assert sides[0] == sides[1]


def test_out_of_fold_scores_know_nothing_of_their_fold(spark):
    """A target that only a row's key tells can be learnt from copies of the key, so folds keep copies together."""
    rng = np.random.default_rng(4)
    rows = [(k, float(k), int(rng.integers(0, 2)), None if c else 1.0) for k in range(120) for c in range(4)]
    rows = [(k, x, rows[4 * (i // 4)][2], z) for i, (k, x, _, z) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k int, x double, y int, sparse double")
    done = cross_validate(df, "y", "decision_tree", ["k"], folds=3, keep=["k"])
    found = done.scored.collect()
    assert len(found) == 480 and {r.fold for r in found} == {0, 1, 2} and len(done.models) == 3
    assert done.scored.groupBy("k").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert all("sparse" not in m.features for m in done.models)
    share = sum(r.label == r.prediction for r in found) / 480
    assert share < 0.7
    kept = {r.fold: (r.rows, r.accuracy) for r in done.metrics.collect()}
    assert sum(n for n, _ in kept.values()) == 480 and sum(n * a for n, a in kept.values()) == pytest.approx(480 * share)
    with pytest.raises(ValueError, match="two folds"):
        cross_validate(df, "y", "decision_tree", folds=1)


def training_rows(spark, rows):
    """(features ..., label) tuples as a prepared frame whose rows all train."""
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType())])
    made = spark.createDataFrame([(Vectors.dense([float(v) for v in r[:-1]]), float(r[-1])) for r in rows], schema)
    return made.withColumn("split", F.lit("train"))


def test_tree_tests_the_size_of_a_node_before_its_split(spark):
    """A split of ten rows into nine and one is legal; a node of fewer rows than the limit stays a leaf."""
    rows = [(i, 0) for i in range(9)] + [(9, 1)] + [(i, 2) for i in range(20, 40)]
    frame = training_rows(spark, rows)
    grown = {n: models.train_tree(frame, ["x"], 3, max_depth=None, min_samples_split=n).model.trees[0][0] for n in (2, 10, 11, 31)}
    assert grown[2] == grown[10] and grown[10].n_leaves == 3 and sorted(t for t in grown[10].threshold if t) == [8.5, 14.5]
    assert grown[11].n_leaves == 2 and grown[31].n_leaves == 1
    assert models.train_tree(frame, ["x"], 3, min_samples_leaf=2).model.trees[0][0].n_leaves == 3
    assert models.train_tree(frame, ["x"], 3, max_depth=1).model.depth == 1


def test_tree_is_not_bound_in_depth(spark):
    """Alternating classes of a sorted feature, with shares that peel off one value a level."""
    rows = [(i, i % 2) for i in range(40) for _ in range(1 << min(i, 12))]
    model = models.train_tree(training_rows(spark, rows), ["x"], 2, max_depth=None).model
    assert model.depth > 30 or model.n_leaves == 40
    assert all(model.scores(np.array([[float(i)]]))[0].argmax() == i % 2 for i in range(40))


def plain_gini(x, y, n_classes, max_depth, min_split, min_leaf):
    """Nested dict of a greedy Gini tree over all thresholds, lowest feature and threshold first."""
    counts = np.bincount(y, minlength=n_classes)
    own = {"counts": counts.tolist()}
    if max_depth == 0 or len(y) < max(2, min_split) or (counts > 0).sum() < 2:
        return own
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            left = x[:, f] <= (low + high) / 2
            if min(left.sum(), (~left).sum()) < min_leaf:
                continue
            purity = sum((np.bincount(y[s], minlength=n_classes) ** 2).sum() / s.sum() for s in (left, ~left))
            if best is None or round(purity, 9) > round(best[0], 9):
                best = (purity, f, left)
    if best is None:
        return own
    return own | {"feature": best[1], "left": plain_gini(x[best[2]], y[best[2]], n_classes, max_depth - 1, min_split, min_leaf),
                  "right": plain_gini(x[~best[2]], y[~best[2]], n_classes, max_depth - 1, min_split, min_leaf)}


def as_dict(tree, node=0):
    own = {"counts": [int(c) for c in tree.value[node]]}
    if tree.feature[node] < 0:
        return own
    return own | {"feature": tree.feature[node], "left": as_dict(tree, tree.left[node]), "right": as_dict(tree, tree.left[node] + 1)}


@pytest.mark.parametrize("seed, parameters", [(1, (6, 2, 1)), (2, (20, 12, 1)), (3, (20, 2, 7))])
def test_tree_equals_plain_growth(spark, seed, parameters):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (500, 3))
    y = (x[:, 0] + x[:, 1] * rng.integers(0, 2, 500)) // 5 % 3
    model = models.train_tree(training_rows(spark, np.column_stack([x, y]).tolist()).repartition(5), list("abc"), 3, *parameters).model
    assert as_dict(model.trees[0][0]) == plain_gini(x, y, 3, *parameters)


def plain_boosting(x, y, n_classes, rounds, depth, rate):
    """Scores of second-order boosting by trying every threshold, L2 of 1 and a least Hessian of 1."""
    outputs = 1 if n_classes == 2 else n_classes
    margin = np.full((len(y), outputs), 4 * (y.mean() - 0.5) if n_classes == 2 else 0.0)

    def grow(rows, g, h, level):
        weight = -g[rows].sum() / (h[rows].sum() + 1) * rate
        best = (1e-6, None)
        if level < depth:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(h[left].sum(), h[right].sum()) < 1:
                        continue
                    gain = sum(s * g[r].sum() ** 2 / (h[r].sum() + 1) for s, r in ((1, left), (1, right), (-1, rows)))
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if best[1] is None:
            return [(rows, weight)]
        return grow(best[1][0], g, h, level + 1) + grow(best[1][1], g, h, level + 1)

    for _ in range(rounds):
        if n_classes == 2:
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y[:, None], p * (1 - p)
        else:
            e = np.exp(margin)
            p = e / e.sum(axis=1, keepdims=True)
            g, h = p - np.eye(n_classes)[y], 2 * p * (1 - p)
        for k in range(outputs):
            for rows, weight in grow(np.arange(len(y)), g[:, k], h[:, k], 0):
                margin[rows, k] += weight
    if n_classes == 2:
        p = 1 / (1 + np.exp(-margin[:, 0]))
        return np.column_stack([1 - p, p])
    e = np.exp(margin)
    return e / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("n_classes", [2, 3])
def test_boosting_equals_plain_rounds(spark, n_classes):
    rng = np.random.default_rng(n_classes)
    x = rng.normal(size=(150, 3)).round(1)
    y = (np.abs(x[:, 0] + x[:, 1]) + rng.normal(size=150) * 0.3 > 0.8).astype(int) + (n_classes - 2) * (x[:, 2] > 0.5)
    frame = training_rows(spark, np.column_stack([x, y]).tolist()).repartition(4)
    trained = models.train_boosting(frame, list("abc"), n_classes, n_estimators=4, max_depth=3)
    assert np.allclose(trained.model.scores(x), plain_boosting(x, y, n_classes, 4, 3, 0.3), atol=1e-9)
    scored = models.score(trained, frame).collect()
    assert all(r["prediction"] == int(np.argmax(r["scores"])) for r in scored)


def test_histograms_in_groups_and_by_tree_reduction_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    frame = training_rows(spark, np.column_stack([x, y]).tolist()).repartition(6)
    one = [f(frame, list("abcd"), 2, max_depth=4, max_bins=32) for f in (models.train_tree, lambda *a, **k: models.train_boosting(*a, n_estimators=3, **k))]
    for name, value in (("MOST_NUMBERS", 500), ("TASK_CELLS", 100), ("DIRECT_TASKS", 1), ("CHECKPOINT_ROUNDS", 2)):
        monkeypatch.setattr(trees, name, value)
    two = [f(frame, list("abcd"), 2, max_depth=4, max_bins=32) for f in (models.train_tree, lambda *a, **k: models.train_boosting(*a, n_estimators=3, **k))]
    for a, b in zip(one, two):
        assert np.allclose(a.model.scores(x), b.model.scores(x)) and a.model.n_leaves == b.model.n_leaves
    assert np.mean(one[1].model.scores(x).argmax(axis=1) == y) > 0.8


def test_boosting_by_samples(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 6))
    y = (x[:, 0] > 0.3).astype(int)
    frame = training_rows(spark, np.column_stack([x, y]).tolist())
    both = [models.train_boosting(frame, list("abcdef"), 2, n_estimators=20, max_depth=3, subsample=0.5, colsample_bytree=0.5).model for _ in range(2)]
    assert both[0].trees == both[1].trees
    assert all(len({f for f in t.feature if f >= 0}) <= 3 for (t,) in both[0].trees)
    assert np.mean(both[0].scores(x).argmax(axis=1) == y) > 0.97 and both[0].importance()[0] > 0.5


def test_wide_features_are_cut_at_quantiles(spark):
    frame = training_rows(spark, [(i * i, i % 3, i >= 1500) for i in range(2000)])
    edges = trees.bin_edges(frame, 2, 64)
    assert len(edges[0]) == 63 or len(edges[0]) == 64
    assert edges[1].tolist() == [0.5, 1.5]
    counts = np.diff(np.searchsorted([i * i for i in range(2000)], [-1, *edges[0], 1e9], side="right"))
    assert counts.max() < 3 * 2000 / 64


def test_blocks_of_a_task_are_not_gathered():
    import weakref

    from tablescope.operators import trees

    seen = []

    def blocks():
        for _ in range(5):
            block = np.ones(2)
            seen.append(weakref.ref(block))
            yield block
            del block

    def histogram(block):
        assert sum(r() is not None for r in seen) <= 2
        return block

    assert trees.added(blocks(), histogram, 2).tolist() == [5.0, 5.0]


def test_leaves_by_bits_are_those_of_the_walk():
    rng = np.random.default_rng(5)
    for depth in (0, 1, 3, 6, 8):  # the last one has too many leaves for bits
        tree = trees.Tree()
        level = [tree.add(0.0, 0)]
        for d in range(depth):
            after = []
            for v in level:
                tree.feature[v], tree.bin[v] = int(rng.integers(4)), int(rng.integers(9))
                tree.threshold[v] = tree.bin[v] + 0.5
                tree.left[v] = tree.add(float(rng.normal()), d + 1)
                after += [tree.left[v], tree.add(float(rng.normal()), d + 1)]
            level = after
        bins = rng.integers(0, 10, (4, 500)).astype(np.uint8)
        expected = tree.route(bins, tree.bin)
        assert (tree.place(bins, tree.bin, 10) == expected).all()
        values = bins.T.astype(float)
        values[3, 1] = np.nan
        forest = trees.Forest([[tree], [tree]], 4, 2, boosted=True, start=0.25)
        leaf = tree.route(np.ascontiguousarray(values.T), tree.threshold)
        weight = np.array(tree.value)[leaf]
        assert forest.margins(values)[:, 0].tolist() == (0.25 + weight + weight).tolist()


def test_families_share_statistics_and_split(spark, monkeypatch):
    from tablescope.plans import training

    df = learnable(spark).withColumn("wide", F.concat(F.lit("w"), F.col("row") % 60))
    df = df.withColumn("wider", F.concat(F.lit("w"), F.col("row") % 150)).withColumn("a", F.when(F.col("row") % 9 != 0, F.col("a")))
    families = list(training.TRAINERS)
    expected = {m: prepare(df, "target", m, ["row"]) for m in families}
    calls = []

    def counted(function):
        def call(*args, **kwargs):
            calls.append(function.__name__)
            return function(*args, **kwargs)

        return call

    for module, name in ((training, "stratified_split"), (features, "base_statistics"), (features, "unique_stats"), (features, "listed_frequencies")):
        monkeypatch.setattr(module, name, counted(getattr(module, name)))
    found = prepare_each(df, "target", families, ["row"])
    assert sorted(calls) == ["base_statistics", "listed_frequencies", "stratified_split", "unique_stats"]
    rows = lambda p: sorted((r["split"], r["label"], r["features"].toArray().tolist()) for r in p.frame.collect())
    for m in families:
        assert rows(found[m]) == rows(expected[m])
        for name in ("features", "dropped", "decisions", "encoded", "medians", "scaling", "labels", "numeric", "missing_values_handled", "target_conversion"):
            assert getattr(found[m].plan, name) == getattr(expected[m].plan, name)
    assert [len(found[m].plan.dropped) for m in families] == [2, 1, 0]
    assert len({id(p.frame) for p in found.values()}) == 3
    alike = prepare_each(learnable(spark), "target", families, ["row"])
    assert alike["decision_tree"].frame is alike["gradient_boosting"].frame is not alike["logistic_regression"].frame


def _blocks(rng, n_classes, sizes=(300, 200, 40)):
    return [(i, rng.integers(0, 9, (3, n)).astype(np.uint8), rng.integers(0, n_classes, n).astype(np.int32)) for i, n in enumerate(sizes)]


@pytest.mark.parametrize("n_classes", [2, 3])
def test_slopes_are_found_once_a_round(monkeypatch, n_classes):
    """In one task each block's gradients are kept for the levels of a round; without room they are found anew."""
    calls = []
    gradients = trees.gradients
    monkeypatch.setattr(trees, "gradients", lambda *a: calls.append(1) or gradients(*a))
    monkeypatch.setattr(trees, "bin_edges", lambda *a: [np.arange(8) + 0.5] * 3)
    monkeypatch.setattr(trees, "blocks_of", lambda *a: _blocks(np.random.default_rng(3), n_classes))
    monkeypatch.setattr(trees, "grown", lambda blocks, grow: grow(trees.InTask(iter(blocks))))
    for subsample in (1.0, 0.6):
        del calls[:]
        forest = trees.fit_boosting(None, 3, n_classes, n_estimators=4, max_depth=4, subsample=subsample)
        assert len(calls) == 4 * 3
        with monkeypatch.context() as tight:
            tight.setattr(trees, "TASK_CELLS", 100)
            assert trees.fit_boosting(None, 3, n_classes, n_estimators=4, max_depth=4, subsample=subsample) == forest
        assert len(calls) > 8 * 3


def test_rows_beside_the_nodes_are_not_counted():
    rng = np.random.default_rng(4)
    bins, slot, weight = rng.integers(0, 5, (2, 400)).astype(np.uint8), rng.integers(0, 4, 400), rng.random(400)
    cells = trees._cells(bins, slot, 3, 5, [weight])
    own = slot < 3
    assert (cells == trees._cells(bins[:, own], slot[own], 3, 5, [weight[own]])).all()
    for f in range(2):
        for s in range(3):
            assert np.allclose(cells[s, f, :, 0], [weight[(slot == s) & (bins[f] == b)].sum() for b in range(5)])


def test_boosting_in_one_task_up_to_the_work_of_a_job(spark, monkeypatch):
    df = learnable(spark).repartition(4)
    frame = prepare(df, "target", "gradient_boosting", ["row"]).frame.select("features", "label").repartition(4)
    monkeypatch.setattr(trees, "TASK_CELLS", 800)  # 600 rows of 4 features: 2,400 cells
    edges = trees.bin_edges(frame, 4, 16)
    parts = [trees.blocks_of(frame, edges, outputs).getNumPartitions() for outputs in (None, 1, 3)]
    assert parts == [3, 1, 3]
