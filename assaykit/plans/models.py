"""The model menu of each task: name -> how to fit on prepared rows; users add their own entries here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.models import hist_tree, knn, linear, logistic, mlp, trees
from assaykit.operators.split import class_counts
from assaykit.table import c


@dataclass(frozen=True)
class Entry:
    """``fit(train, features, target, row_id, **knobs)`` returns a function DataFrame -> DataFrame with ``prediction``."""

    name: str
    task: str
    fit: Callable[..., Callable[[DataFrame], DataFrame]]
    space: dict[str, tuple] = field(default_factory=dict)
    supports_missing: bool = False
    searchable: bool = True


MENU: dict[tuple[str, str], Entry] = {}


def register(entry: Entry) -> Entry:
    MENU[(entry.task, entry.name)] = entry
    return entry


def models_for(task: str, with_missing: bool = False) -> list[Entry]:
    return [e for (t, _), e in MENU.items() if t == task and (e.supports_missing or not with_missing)]


def _codes(df: DataFrame, target: str) -> tuple[int, ...]:
    return tuple(sorted(int(k) for k in class_counts(df, target)))


@dataclass(frozen=True)
class ByTransform:
    """Predicts with the ``transform`` of a fitted model."""

    model: object

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


@dataclass(frozen=True)
class ByLibrary:
    """Predicts with a library pipeline."""

    model: object

    def __call__(self, df: DataFrame) -> DataFrame:
        return trees.predict(self.model, df)


@dataclass(frozen=True)
class ByNeighbours:
    """Predicts from training rows, which are the model."""

    predictor: Callable
    train: DataFrame
    features: tuple[str, ...]
    target: str
    row_id: str
    settings: dict

    def __call__(self, df: DataFrame) -> DataFrame:
        found = self.predictor(self.train, df, self.features, self.target, self.row_id, **self.settings)
        return df.join(found.select(self.row_id, "prediction"), self.row_id)


def _via_transform(fit):
    def run(train, features, target, row_id, **kw):
        return ByTransform(fit(train, features, target, row_id, **kw))

    return run


def _mllib(fit):
    def run(train, features, target, row_id, **kw):
        return ByLibrary(fit(train, features, target, **kw))

    return run


def _knn(predictor):
    def run(train, features, target, row_id, **kw):
        kept = train.select(c(row_id), *[c(f) for f in features], c(target))
        return ByNeighbours(predictor, kept, tuple(features), target, row_id, kw)

    return run


def _add(task, name, fit, space=None, **kw):
    register(Entry(name, task, fit, space or {}, **kw))


_ALPHA = (1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0)
_DEPTH = (2, 3, 4, 5, 6)
_TREES = (10, 20, 40)

_add("regression", "linear", _via_transform(lambda d, f, y, r: linear.linear_regression(d, f, y)), searchable=False)
_add("regression", "polynomial", _via_transform(lambda d, f, y, r, **k: linear.polynomial_regression(d, f, y, **k)), searchable=False)
_add("regression", "knn", _knn(knn.knn_regression), {"k": (2, 3, 5, 8, 13), "weights": ("uniform", "distance"), "p": (1.0, 2.0)})
_add("regression", "svm", _via_transform(lambda d, f, y, r, **k: linear.svm_regression(d, f, y, r, **k)), {"C": (0.1, 1.0, 10.0), "kernel": ("linear", "rbf", "poly")})
_add("regression", "decision_tree", _mllib(trees.decision_tree_regression), {"max_depth": _DEPTH, "min_leaf": (1, 2, 5)})
_add("regression", "random_forest", _mllib(trees.random_forest_regression), {"trees": _TREES, "max_depth": _DEPTH})
_add("regression", "extra_trees", _via_transform(hist_tree.random_cut_forest), {"trees": _TREES, "max_depth": _DEPTH})
_add("regression", "gradient_boosting", _via_transform(hist_tree.gradient_boosting_regression), {"rounds": _TREES, "max_depth": (2, 3, 4), "rate": (0.05, 0.1, 0.3)})
_add("regression", "xgboost", _via_transform(hist_tree.xgb_regression), {"rounds": _TREES, "max_depth": _DEPTH, "rate": (0.1, 0.3), "l2": (0.1, 1.0, 10.0)}, supports_missing=True)
_add("regression", "mlp", _via_transform(lambda d, f, y, r, **k: mlp.fit_network(d, f, y, **k)), {"hidden": ()})
_add("regression", "ridge", _via_transform(lambda d, f, y, r, **k: linear.ridge(d, f, y, **k)), {"alpha": _ALPHA})
_add("regression", "lasso", _via_transform(lambda d, f, y, r, **k: linear.lasso(d, f, y, **k)), {"alpha": _ALPHA})
_add("regression", "elastic_net", _via_transform(lambda d, f, y, r, **k: linear.elastic_net(d, f, y, **k)), {"alpha": _ALPHA, "l1_ratio": (0.1, 0.5, 0.9)})
_add("regression", "sgd", _via_transform(lambda d, f, y, r, **k: linear.sgd_regression(d, f, y, **k)), {"alpha": _ALPHA, "loss": ("squared_error", "huber")})
_add("regression", "bayesian_ridge", _via_transform(lambda d, f, y, r, **k: linear.bayesian_ridge(d, f, y, **k)), {"alpha_1": (1e-6, 1e-3), "lambda_1": (1e-6, 1e-3)})

_add("classification", "logistic", _via_transform(lambda d, f, y, r, **k: logistic.logistic_regression(d, f, y, **k)), {"C": (0.01, 0.1, 1.0, 10.0), "penalty": ("l1", "l2")})
_add("classification", "svm", _via_transform(lambda d, f, y, r, **k: linear.svm_classification(d, f, y, r, _codes(d, y), **k)), {"C": (0.1, 1.0, 10.0), "kernel": ("linear", "rbf", "poly")})
_add("classification", "decision_tree", _mllib(trees.decision_tree_classification), {"max_depth": _DEPTH, "criterion": ("gini", "entropy")})
_add("classification", "random_forest", _mllib(trees.random_forest_classification), {"trees": _TREES, "max_depth": _DEPTH})
_add("classification", "extra_trees", _via_transform(lambda d, f, y, r, **k: hist_tree.random_cut_forest(d, f, y, r, classes=_codes(d, y), **k)), {"trees": _TREES, "max_depth": _DEPTH})
_add("classification", "gradient_boosting", _via_transform(hist_tree.gradient_boosting_classification), {"rounds": _TREES, "max_depth": (2, 3, 4)})
_add("classification", "xgboost", _via_transform(hist_tree.xgb_classification), {"rounds": _TREES, "max_depth": _DEPTH, "rate": (0.1, 0.3)}, supports_missing=True)
_add("classification", "mlp", _via_transform(lambda d, f, y, r, **k: mlp.fit_network(d, f, y, classes=_codes(d, y), **k)), {"hidden": ()})
_add("classification", "knn", _knn(knn.knn_classification), {"k": (2, 3, 5, 8, 13), "weights": ("uniform", "distance")})
_add("classification", "sgd", _via_transform(lambda d, f, y, r, **k: linear.sgd_classification(d, f, y, _codes(d, y), **k)), {"alpha": _ALPHA, "loss": ("log_loss", "modified_huber")})
_add("classification", "adaboost", _via_transform(lambda d, f, y, r, **k: trees.adaboost(d, f, y, _codes(d, y), **k)), {"rounds": (5, 10, 20), "max_depth": (1, 2, 3)})


def predicted_name(target: str | None, position: int | None = None) -> str:
    """Column name of a prediction in a scored application table."""
    if target:
        return f"Predicted_{target}"
    return "Predicted Value" if position is None else f"Predicted_Value_{position}"


def score_table(df: DataFrame, row_id: str, prepare: Callable, predictors: dict[str | None, Callable], need: list[str] | None = None) -> DataFrame:
    """Prepare application (or streaming) rows, drop incomplete ones and attach one prediction per target."""
    rows = prepare(df)
    if need:
        rows = rows.na.drop("any", subset=need)
    many = len(predictors) > 1
    for i, (target, predict) in enumerate(predictors.items()):
        rows = predict(rows).withColumnRenamed("prediction", predicted_name(target, i if many else None))
    names = [predicted_name(t, i if many else None) for i, t in enumerate(predictors)]
    return rows.select(c(row_id), *[c(n) for n in names])


def primary_metric(task: str) -> str:
    return "r2" if task == "regression" else "accuracy"


def as_code(df: DataFrame, column: str = "prediction") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("long"))
