"""Linear models: MLlib for least squares and logistic fits, a reweighted-Newton job for the other losses."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.models.losses import evaluate
from assaykit.operators.expand import polynomial_features
from assaykit.operators.sums import fan_out, matrix, sum_arrays, training_frame
from assaykit.table import c

STORAGE = "MEMORY_AND_DISK"


@dataclass(frozen=True)
class LinearModel:
    """Coefficients; the prediction is one column expression, usable in batch and streaming."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    info: dict = field(default_factory=dict)

    def margin(self) -> Column:
        out = F.lit(float(self.intercept))
        for n, w in zip(self.features, self.coefficients):
            out = out + F.lit(float(w)) * c(n)
        return out

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.margin())

    def formula(self, target: str = "y", digits: int = 3) -> str:
        terms = [f"{round(w, digits)}*{n}" for n, w in zip(self.features, self.coefficients)]
        return f"{target} = " + " + ".join([*terms, str(round(self.intercept, digits))]).replace("+ -", "- ")

    def importance(self, spark) -> DataFrame:
        rows = [(n, float(w)) for n, w in zip(self.features, self.coefficients)]
        return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.desc(F.abs("coefficient")))


def _assembled(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    frame = training_frame(df, features, target)
    names = [f"x{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(frame).select("features", F.col("y").alias("label"))


def _mllib(df, features, target, fit_intercept, **params) -> LinearModel:
    lr = LinearRegression(solver="normal", fitIntercept=fit_intercept, standardization=False, **params)
    model = lr.fit(_assembled(df, features, target))
    return LinearModel(tuple(features), tuple(float(v) for v in model.coefficients), float(model.intercept))


def _moments(df: DataFrame, features: Sequence[str], target: str):
    y = c(target).cast("double")
    known = y.isNotNull()
    for f in features:
        known = known & c(f).isNotNull()
    return df.filter(known).agg(F.count("*").alias("n"), F.stddev_pop(y).alias("s")).first()


def linear_regression(df: DataFrame, features: Sequence[str], target: str, fit_intercept: bool = True) -> LinearModel:
    return _mllib(df, features, target, fit_intercept, regParam=0.0)


def multi_target(df: DataFrame, features: Sequence[str], targets: Sequence[str], fit: Callable = linear_regression, **kw) -> dict:
    """One model per target column on one cached frame."""
    frame = df.select(*[c(n) for n in dict.fromkeys([*features, *targets])]).persist()
    try:
        return {t: fit(frame, features, t, **kw) for t in targets}
    finally:
        frame.unpersist()


@dataclass(frozen=True)
class PolynomialModel:
    features: tuple[str, ...]
    degree: int
    interaction_only: bool
    linear: LinearModel

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        wide = polynomial_features(df, self.features, self.degree, self.interaction_only, False)
        exact = {n: n for n in wide.columns}
        assert tuple(exact) == self.linear.features
        out = F.lit(self.linear.intercept)
        from assaykit.operators.expand import polynomial_terms

        for term, w in zip(polynomial_terms(len(self.features), self.degree, self.interaction_only, False), self.linear.coefficients):
            product = F.lit(w)
            for i in term:
                product = product * c(self.features[i]).cast("double")
            out = out + product
        return df.withColumn(output, out)


def polynomial_regression(
    df: DataFrame, features: Sequence[str], target: str, degree: int = 2, interaction_only: bool = False, fit_intercept: bool = True
) -> PolynomialModel:
    wide = polynomial_features(df, features, degree, interaction_only, False, keep=[target])
    terms = [n for n in wide.columns if n != target]
    return PolynomialModel(tuple(features), degree, interaction_only, linear_regression(wide, terms, target, fit_intercept))


def ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, fit_intercept: bool = True) -> LinearModel:
    """min |y - Xw|^2 + alpha |w|^2; the library's penalty is scaled by n and the population std of y."""
    m = _moments(df, features, target)
    return _mllib(df, features, target, fit_intercept, elasticNetParam=0.0, regParam=alpha / m["n"] * m["s"])


def _gram(df: DataFrame, features: Sequence[str], target: str, centre: bool = True):
    """n, means of X, mean of y, X'X, X'y, y'y about the means: two passes."""
    d = len(features)
    frame = training_frame(df, features, target)
    row = frame.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(d)]).first()
    if not row["n"]:
        raise ValueError("no rows to fit on")
    my = row["y"] if centre else 0.0
    mx = np.array([row[f"x{i}"] if centre else 0.0 for i in range(d)])

    def products(pdf):
        z = np.column_stack([matrix(pdf, d) - mx, pdf["y"].to_numpy() - my])
        return (z.T @ z).ravel()

    g = sum_arrays(frame, products, fan_out(frame)).reshape(d + 1, d + 1)
    return row["n"], mx, my, g[:d, :d], g[:d, d], g[d, d]


def elastic_net(
    df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, l1_ratio: float = 0.5, fit_intercept: bool = True
) -> LinearModel:
    """min |y - Xw|^2 / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) / 2 |w|^2).

    Coordinate descent on the Gram matrix: the rows are read twice however many sweeps it takes.
    """
    n, mx, my, xx, xy, _ = _gram(df, features, target, fit_intercept)
    d = len(features)
    w = _penalised_step(xx / n, -xy / n, np.zeros(d), alpha * l1_ratio, alpha * (1 - l1_ratio), np.zeros(d, dtype=bool), sweeps=5000)
    return LinearModel(tuple(features), tuple(float(v) for v in w), float(my - w @ mx))


def lasso(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, fit_intercept: bool = True) -> LinearModel:
    """min |y - Xw|^2 / 2n + alpha |w|_1."""
    return elastic_net(df, features, target, alpha, 1.0, fit_intercept)


@dataclass(frozen=True)
class BayesianRidgeModel:
    linear: LinearModel
    covariance: np.ndarray
    means: np.ndarray
    alpha: float
    penalty: float
    rounds: int

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Prediction and its standard deviation, both as column math."""
        out = self.linear.transform(df, output)
        d = len(self.linear.features)
        centred = [c(n) - F.lit(float(self.means[i])) for i, n in enumerate(self.linear.features)]
        var = F.lit(1.0 / self.alpha)
        for i in range(d):
            for j in range(d):
                var = var + F.lit(float(self.covariance[i, j])) * centred[i] * centred[j]
        return out.withColumn(output + "_std", F.sqrt(var))


def bayesian_ridge(
    df: DataFrame, features: Sequence[str], target: str, max_iter: int = 300, tol: float = 1e-3, alpha_1: float = 1e-6,
    alpha_2: float = 1e-6, lambda_1: float = 1e-6, lambda_2: float = 1e-6,
) -> BayesianRidgeModel:
    """Evidence iteration on the centred Gram matrix: the data are read twice whatever the number of rounds."""
    n, mx, my, xx, xy, yy = _gram(df, features, target)
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    alpha, lam = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    old, rounds = None, 0

    def solve():
        w = vectors @ ((vectors.T @ xy) / (values + lam / alpha))
        return w, max(0.0, float(yy - 2 * w @ xy + w @ xx @ w))

    for rounds in range(1, max_iter + 1):
        w, sse = solve()
        gamma = float(np.sum(alpha * values / (lam + alpha * values)))
        lam = (gamma + 2 * lambda_1) / (float(w @ w) + 2 * lambda_2)
        alpha = (n - gamma + 2 * alpha_1) / (sse + 2 * alpha_2)
        if old is not None and np.abs(w - old).sum() < tol:
            break
        old = w
    w, _ = solve()
    covariance = (vectors / (alpha * values + lam)) @ vectors.T
    linear = LinearModel(tuple(features), tuple(float(v) for v in w), float(my - w @ mx))
    return BayesianRidgeModel(linear, covariance, mx, float(alpha), float(lam), rounds)


# ---------------------------------------------------------------- reweighted Newton for any loss
def _penalised_step(h, g, w, l1, l2, free, sweeps=500):
    """Minimise g.(v-w) + (v-w)'h(v-w)/2 + l1|v| + l2|v|^2/2 over v; ``free`` marks unpenalised entries."""
    d = len(w)
    ridge_part = np.where(free, 0.0, l2)
    a = h + np.diag(ridge_part)
    b = h @ w - g
    if l1 == 0:
        return np.linalg.solve(a + 1e-12 * np.trace(a) / d * np.eye(d), b)
    v = w.copy()
    for _ in range(sweeps):
        biggest = 0.0
        for j in range(d):
            rest = b[j] - a[j] @ v + a[j, j] * v[j]
            new = rest / a[j, j] if free[j] else math.copysign(max(abs(rest) - l1, 0.0), rest) / max(a[j, j], 1e-300)
            biggest = max(biggest, abs(new - v[j]))
            v[j] = new
        if biggest < 1e-12 * (1 + np.abs(v).max()):
            break
    return v


@dataclass(frozen=True)
class LandmarkMap:
    """Kernel features from a bounded set of landmark rows (Nystroem form)."""

    landmarks: np.ndarray
    whiten: np.ndarray
    kernel: str
    gamma: float
    degree: int
    coef0: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return kernel_values(x, self.landmarks, self.kernel, self.gamma, self.degree, self.coef0) @ self.whiten


def kernel_values(x, z, kernel, gamma, degree, coef0):
    if kernel == "rbf":
        d2 = (x**2).sum(1)[:, None] + (z**2).sum(1)[None, :] - 2 * x @ z.T
        return np.exp(-gamma * np.maximum(d2, 0.0))
    if kernel == "poly":
        return (gamma * x @ z.T + coef0) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * x @ z.T + coef0)
    raise ValueError(f"unknown kernel {kernel}")


def landmark_map(
    df: DataFrame, features: Sequence[str], row_id: str, kernel: str, landmarks: int = 100, gamma: float | str = "scale",
    degree: int = 3, coef0: float = 0.0,
) -> LandmarkMap:
    """Landmarks are the rows with the smallest key hash; their number is fixed, so the map does not grow with data."""
    d = len(features)
    if gamma == "scale":
        row = df.agg(
            sum((F.avg(c(f)) for f in features), F.lit(0.0)).alias("s"), sum((F.avg(c(f) * c(f)) for f in features), F.lit(0.0)).alias("q")
        ).first()
        gamma = 1.0 / (d * max(row["q"] / d - (row["s"] / d) ** 2, 1e-12))
    z = df.select(*[c(f).cast("double") for f in features], F.xxhash64(c(row_id)).alias("_h")).orderBy("_h").limit(landmarks)
    z = z.drop("_h").toPandas().to_numpy(dtype=float)
    values, vectors = np.linalg.eigh(kernel_values(z, z, kernel, gamma, degree, coef0))
    keep = values > 1e-10 * values.max()
    return LandmarkMap(z, vectors[:, keep] / np.sqrt(values[keep]), kernel, float(gamma), degree, coef0)


@dataclass(frozen=True)
class NewtonModel:
    """One weight row per output; regression has one, one-vs-rest classification one per class."""

    features: tuple[str, ...]
    weights: np.ndarray
    classes: tuple | None
    loss: str
    history: tuple[float, ...]
    mapper: LandmarkMap | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.mapper(x) if self.mapper is not None else x
        return z @ self.weights[:, :-1].T + self.weights[:, -1]

    def linear(self, output: int = 0) -> LinearModel:
        w = self.weights[output]
        return LinearModel(self.features, tuple(float(v) for v in w[:-1]), float(w[-1]))

    def margins(self, df: DataFrame) -> DataFrame:
        """Add the array column ``margins``."""
        if self.mapper is None:
            return df.withColumn("margins", F.array(*[self.linear(k).margin() for k in range(len(self.weights))]))
        from pyspark.sql.functions import pandas_udf

        model = self

        @pandas_udf("array<double>")
        def score(*cols: pd.Series) -> pd.Series:
            return pd.Series(list(model.scores(np.column_stack([col.to_numpy(dtype=float) for col in cols]))))

        return df.withColumn("margins", score(*[c(f).cast("double") for f in self.features]))

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        out = self.margins(df)
        if self.classes is None:
            return out.withColumn(output, F.col("margins")[0]).drop("margins")
        if len(self.classes) == 2:
            pick = F.when(F.col("margins")[0] > 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0]))
            return out.withColumn(output, pick)
        at = F.array_position("margins", F.array_max("margins")).cast("int")
        return out.withColumn(output, F.element_at(F.array(*[F.lit(v) for v in self.classes]), at))


def newton_fit(
    df: DataFrame, features: Sequence[str], target: str, loss: str, alpha: float = 1e-4, l1_ratio: float = 0.0, epsilon: float = 0.1,
    fit_intercept: bool = True, max_iter: int = 50, tol: float = 1e-8, classes: Sequence | None = None, mapper: LandmarkMap | None = None,
) -> NewtonModel:
    """min mean loss + alpha (l1_ratio |w|_1 + (1 - l1_ratio)/2 |w|^2), intercept free.

    Each round is one pass that sums slopes and weighted Gram matrices; the penalised quadratic is solved on
    the driver. That takes about ten passes where gradient steps take hundreds.
    """
    d = len(features)
    frame = training_frame(df, features, target).persist()
    fan = fan_out(frame)
    outputs = 1 if classes is None or len(classes) == 2 else len(classes)
    width = (mapper.whiten.shape[1] if mapper is not None else d) + 1
    weights = np.zeros((outputs, width))
    free = np.zeros(width, dtype=bool)
    free[-1] = True
    positive = None if classes is None else ([classes[1]] if outputs == 1 else list(classes))

    def one_pass(w):
        def add(pdf):
            x = matrix(pdf, d)
            z = mapper(x) if mapper is not None else x
            z = np.column_stack([z, np.full(len(z), 1.0 if fit_intercept else 0.0)])
            y = pdf["y"].to_numpy()
            parts = []
            for k in range(outputs):
                t = y if positive is None else np.where(y == float(positive[k]), 1.0, -1.0)
                value, slope, curve = evaluate(loss, t, z @ w[k], epsilon)
                parts += [[value.sum()], z.T @ slope, ((z * curve[:, None]).T @ z).ravel()]
            return np.concatenate([*parts, [float(len(y))]])

        s = sum_arrays(frame, add, fan)
        n = s[-1]
        block = 1 + width + width * width
        out = []
        for k in range(outputs):
            b = s[k * block : (k + 1) * block] / n
            penal = alpha * (l1_ratio * np.abs(w[k][:-1]).sum() + (1 - l1_ratio) / 2 * (w[k][:-1] ** 2).sum())
            out.append((b[0] + penal, b[1 : 1 + width], b[1 + width :].reshape(width, width)))
        return out

    try:
        state = one_pass(weights)
        history = [sum(s[0] for s in state)]
        active = np.ones(outputs, dtype=bool)
        for _ in range(max_iter):
            step = weights.copy()
            for k in np.flatnonzero(active):
                hess = state[k][2] if fit_intercept else state[k][2] + np.diag(free * 1.0)
                step[k] = _penalised_step(hess, state[k][1], weights[k], alpha * l1_ratio, alpha * (1 - l1_ratio), free)
            trial = one_pass(step)
            for _ in range(12):
                worse = np.array([t[0] > s[0] + 1e-12 for t, s in zip(trial, state)])
                if not worse.any():
                    break
                step[worse] = (step[worse] + weights[worse]) / 2
                trial = one_pass(step)
            gain = np.array([s[0] - t[0] for s, t in zip(state, trial)])
            active &= gain > tol * np.maximum(1.0, np.abs([t[0] for t in trial]))
            weights, state = step, trial
            history.append(sum(s[0] for s in state))
            if not active.any():
                break
    finally:
        frame.unpersist()
    return NewtonModel(tuple(features), weights, tuple(classes) if classes is not None else None, loss, tuple(history), mapper)


def sgd_regression(
    df: DataFrame, features: Sequence[str], target: str, loss: str = "squared_error", penalty: str | None = "l2", alpha: float = 1e-4,
    l1_ratio: float = 0.15, epsilon: float = 0.1, **kw,
) -> NewtonModel:
    """The stochastic-gradient regressor's objective, minimised exactly: the result does not depend on row order."""
    ratio = {"l1": 1.0, "l2": 0.0, "elasticnet": l1_ratio, None: 0.0}[penalty]
    return newton_fit(df, features, target, loss, alpha if penalty else 0.0, ratio, epsilon, **kw)


def sgd_classification(
    df: DataFrame, features: Sequence[str], target: str, classes: Sequence, loss: str = "log_loss", penalty: str | None = "l2",
    alpha: float = 1e-4, l1_ratio: float = 0.15, **kw,
) -> NewtonModel:
    ratio = {"l1": 1.0, "l2": 0.0, "elasticnet": l1_ratio, None: 0.0}[penalty]
    return newton_fit(df, features, target, loss, alpha if penalty else 0.0, ratio, classes=classes, **kw)


def _kernel(df, features, row_id, kernel, landmarks, gamma, degree, coef0):
    return None if kernel == "linear" else landmark_map(df, features, row_id, kernel, landmarks, gamma, degree, coef0)


def svm_regression(
    df: DataFrame, features: Sequence[str], target: str, row_id: str, kernel: str = "rbf", C: float = 1.0, epsilon: float = 0.1,
    landmarks: int = 100, gamma: float | str = "scale", degree: int = 3, coef0: float = 0.0, **kw,
) -> NewtonModel:
    n = df.count()
    mapper = _kernel(df, features, row_id, kernel, landmarks, gamma, degree, coef0)
    return newton_fit(df, features, target, "epsilon_insensitive", 1.0 / (C * n), 0.0, epsilon, mapper=mapper, **kw)


def svm_classification(
    df: DataFrame, features: Sequence[str], target: str, row_id: str, classes: Sequence, kernel: str = "rbf", C: float = 1.0,
    landmarks: int = 100, gamma: float | str = "scale", degree: int = 3, coef0: float = 0.0, **kw,
) -> NewtonModel:
    n = df.count()
    mapper = _kernel(df, features, row_id, kernel, landmarks, gamma, degree, coef0)
    return newton_fit(df, features, target, "hinge", 1.0 / (C * n), 0.0, classes=classes, mapper=mapper, **kw)


def margin_probability(model: NewtonModel, df: DataFrame, target: str) -> LinearModel:
    """Logistic fit of the positive class on the margin (two classes): probability = 1 / (1 + exp(-(a m + b)))."""
    scored = model.margins(df).select(F.col("margins")[0].alias("margin"), c(target))
    return newton_fit(scored, ["margin"], target, "log_loss", 1e-6, classes=model.classes).linear()
