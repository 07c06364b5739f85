"""The three classifiers, with scores and importances as frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.base import Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.operators import trees
from tablescope.session import shared_path

CANDIDATE_SPLITS = 256


@dataclass
class TrainedModel:
    model_type: str
    model: Model | trees.Forest
    features: list[str]
    n_classes: int
    parameters: dict = field(default_factory=dict)


def _training_rows(prepared: DataFrame) -> DataFrame:
    return prepared.where(F.col("split") == "train").select("features", "label")


def train_logistic(
    prepared: DataFrame, features: list[str], n_classes: int, max_iter: int = 1000, c: float = 1.0
) -> TrainedModel:
    """L2 logistic regression.  Inverse strength ``c`` on a summed loss is 1 / (c * rows) here."""
    train = _training_rows(prepared)
    rows = train.count()
    estimator = LogisticRegression(
        maxIter=max_iter,
        regParam=1 / (c * rows),
        elasticNetParam=0.0,
        standardization=False,
        family="binomial" if n_classes == 2 else "multinomial",
    )
    model = _without_summary(estimator.fit(train), prepared)
    return TrainedModel("logistic_regression", model, features, n_classes, {"max_iter": max_iter, "c": c})


def _without_summary(model: LogisticRegressionModel, prepared: DataFrame) -> LogisticRegressionModel:
    """The model as it comes back from storage.

    A freshly fitted binary model carries its training summary, and with it the session, into
    every scoring task; that fails once the session holds observed metrics.
    """
    path = shared_path(prepared.sparkSession, "logistic")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def train_tree(
    prepared: DataFrame,
    features: list[str],
    n_classes: int,
    max_depth: int | None = 10,
    min_samples_split: int = 2,
    min_samples_leaf: int = 1,
    max_bins: int = CANDIDATE_SPLITS,
) -> TrainedModel:
    """Gini tree; ``max_depth=None`` grows until no split is legal."""
    forest = trees.fit_tree(
        _training_rows(prepared), len(features), n_classes, max_depth, min_samples_split, min_samples_leaf, max_bins
    )
    parameters = {
        "max_depth": max_depth, "min_samples_split": min_samples_split, "min_samples_leaf": min_samples_leaf,
        "max_bins": max_bins,
    }
    return TrainedModel("decision_tree", forest, features, n_classes, parameters)


def train_boosting(
    prepared: DataFrame,
    features: list[str],
    n_classes: int,
    n_estimators: int = 100,
    max_depth: int = 6,
    learning_rate: float = 0.3,
    subsample: float = 1.0,
    colsample_bytree: float = 1.0,
    max_bins: int = CANDIDATE_SPLITS,
    seed: int = 42,
) -> TrainedModel:
    """Second-order boosting: logistic loss for two classes, softmax for more."""
    parameters = {
        "n_estimators": n_estimators, "max_depth": max_depth, "learning_rate": learning_rate,
        "subsample": subsample, "colsample_bytree": colsample_bytree, "max_bins": max_bins,
    }
    forest = trees.fit_boosting(_training_rows(prepared), len(features), n_classes, seed=seed, **parameters)
    return TrainedModel("gradient_boosting", forest, features, n_classes, parameters)


def score(trained: TrainedModel, prepared: DataFrame) -> DataFrame:
    """Add ``prediction`` (the lowest class of highest score) and ``scores`` (one per class) to the prepared rows."""
    if isinstance(trained.model, trees.Forest):
        scored = prepared.withColumn("scores", trained.model.score_column("features"))
        best = F.array_position("scores", F.array_max("scores")) - 1
        return scored.withColumn("prediction", best.cast("double")).drop("features")
    predicted = trained.model.transform(prepared).withColumn("scores", vector_to_array("probability"))
    return predicted.drop("rawPrediction", "probability", "features")


def tree_structure(trained: TrainedModel) -> dict:
    return {"tree_depth": trained.model.depth, "n_leaves": trained.model.n_leaves}


def _importances(trained: TrainedModel) -> tuple[list[float], list[float | None]]:
    model, n = trained.model, len(trained.features)
    if trained.model_type == "logistic_regression":
        rows = model.coefficientMatrix.toArray()
        size = [float(sum(abs(r[j]) for r in rows) / len(rows)) for j in range(n)]
        signed = [float(rows[0][j]) if len(rows) == 1 else None for j in range(n)]
        return size, signed
    return model.importance(), [None] * n


def feature_importance(trained: TrainedModel, prepared: DataFrame) -> DataFrame:
    """(feature, importance, coefficient): mean |coefficient| over classes or tree importance."""
    size, signed = _importances(trained)
    rows = list(zip(trained.features, size, signed))
    return prepared.sparkSession.createDataFrame(rows, "feature string, importance double, coefficient double")
