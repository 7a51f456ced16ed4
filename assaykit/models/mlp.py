"""Multi-layer perceptron with L-BFGS or Adam on full gradients; each step is one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.sums import fan_out, matrix, sum_arrays, training_frame
from assaykit.table import c

ACTIVATIONS = ("identity", "logistic", "tanh", "relu")


def _act(name, z):
    if name == "identity":
        return z
    if name == "logistic":
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    return np.tanh(z) if name == "tanh" else np.maximum(z, 0.0)


def _slope(name, a):
    if name == "identity":
        return np.ones_like(a)
    if name == "logistic":
        return a * (1 - a)
    return 1 - a * a if name == "tanh" else (a > 0).astype(float)


@dataclass(frozen=True)
class Network:
    features: tuple[str, ...]
    sizes: tuple[int, ...]
    activation: str
    weights: np.ndarray
    classes: tuple | None
    losses: tuple[float, ...]

    def forward(self, x: np.ndarray) -> np.ndarray:
        out = _forward(self.weights, x, self.sizes, self.activation, self.classes is not None)[-1]
        return np.column_stack([1 - out[:, 0], out[:, 0]]) if self.classes is not None and out.shape[1] == 1 else out

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        from pyspark.sql.functions import pandas_udf

        net = self

        @pandas_udf("array<double>")
        def score(*cols: pd.Series) -> pd.Series:
            return pd.Series(list(net.forward(np.column_stack([col.to_numpy(dtype=float) for col in cols]))))

        out = df.withColumn("probability", score(*[c(f).cast("double") for f in self.features]))
        if self.classes is None:
            return out.withColumn(output, F.col("probability")[0]).drop("probability")
        at = F.array_position("probability", F.array_max("probability")).cast("int")
        return out.withColumn(output, F.element_at(F.array(*[F.lit(v) for v in self.classes]), at))

    def loss_curve(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.losses)], "step int, loss double")


def _layers(w, sizes):
    at, out = 0, []
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _forward(w, x, sizes, activation, classify):
    steps = [x]
    layers = _layers(w, sizes)
    for i, (m, b) in enumerate(layers):
        z = steps[-1] @ m + b
        if i < len(layers) - 1:
            steps.append(_act(activation, z))
        elif not classify:
            steps.append(z)
        elif sizes[-1] == 1:
            steps.append(_act("logistic", z))
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            steps.append(e / e.sum(axis=1, keepdims=True))
    return steps


def fit_network(
    df: DataFrame, features: Sequence[str], target: str, hidden: Sequence[int] = (50, 25, 5), activation: str = "relu", solver: str = "adam",
    alpha: float = 1e-4, learning_rate: float = 1e-3, max_iter: int = 200, tol: float = 1e-4, patience: int = 10, seed: int = 42,
    classes: Sequence | None = None,
) -> Network:
    """Squared loss for a number, log loss for classes, plus alpha/2 |w|^2 / n. Results do not depend on row order."""
    if activation not in ACTIVATIONS:
        raise ValueError(f"activation must be one of {ACTIVATIONS}")
    d = len(features)
    last = 1 if classes is None or len(classes) == 2 else len(classes)
    sizes = (d, *hidden, last)
    rng = np.random.default_rng(seed)
    parts, mask = [], []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = np.sqrt((2.0 if activation == "logistic" else 6.0) / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        mask += [np.ones(a * b), np.zeros(b)]
    w, mask = np.concatenate(parts), np.concatenate(mask)
    frame = training_frame(df, features, target).persist()
    fan = fan_out(frame)

    def one_pass(weights):
        def add(pdf):
            x, y = matrix(pdf, d), pdf["y"].to_numpy()
            steps = _forward(weights, x, sizes, activation, classes is not None)
            out = steps[-1]
            if classes is None:
                t = y[:, None]
                value = 0.5 * ((out - t) ** 2).sum()
            elif last == 1:
                t = (y == float(classes[1])).astype(float)[:, None]
                value = -np.log(np.clip(np.where(t > 0, out, 1 - out), 1e-15, 1)).sum()
            else:
                t = (y[:, None] == np.array(classes, dtype=float)[None, :]).astype(float)
                value = -np.log(np.clip((out * t).sum(axis=1), 1e-15, 1)).sum()
            delta, grads = out - t, []
            layers = _layers(weights, sizes)
            for i in reversed(range(len(layers))):
                grads = [(steps[i].T @ delta).ravel(), delta.sum(axis=0), *grads]
                if i:
                    delta = (delta @ layers[i][0].T) * _slope(activation, steps[i])
            return np.concatenate([*grads, [value, float(len(y))]])

        s = sum_arrays(frame, add, fan)
        n = s[-1]
        penal = 0.5 * alpha * float((weights * mask) @ weights) / n
        return s[-2] / n + penal, (s[:-2] + alpha * weights * mask) / n

    try:
        solve = _adam if solver in ("adam", "sgd") else _lbfgs
        w, losses = solve(one_pass, w, learning_rate, max_iter, tol, patience, solver)
    finally:
        frame.unpersist()
    return Network(tuple(features), sizes, activation, w, tuple(classes) if classes is not None else None, tuple(losses))


def _adam(one_pass, w, rate, max_iter, tol, patience, solver):
    m, v, losses, best, idle = np.zeros_like(w), np.zeros_like(w), [], np.inf, 0
    for t in range(1, max_iter + 1):
        value, g = one_pass(w)
        losses.append(value)
        idle = 0 if value < best - tol else idle + 1
        best = min(best, value)
        if idle > patience:
            break
        if solver == "sgd":
            m = 0.9 * m - rate * g
            w = w + 0.9 * m - rate * g
        else:
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, losses


def _lbfgs(one_pass, w, rate, max_iter, tol, patience, solver, memory=10):
    value, g = one_pass(w)
    losses, pairs = [value], []
    for _ in range(max_iter):
        q, a = g.copy(), []
        for s, y in reversed(pairs):
            k = (s @ q) / (y @ s)
            a.append(k)
            q -= k * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), k in zip(pairs, reversed(a)):
            q += s * (k - (y @ q) / (y @ s))
        step = 1.0 if pairs else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        slope = -(g @ q)
        if slope >= 0:
            break
        for _ in range(20):
            new, grad = one_pass(w - step * q)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, grad - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        w, g, gain, value = w - step * q, grad, value - new, new
        losses.append(value)
        if np.abs(g).max() < tol or gain < 1e-9 * max(1.0, abs(value)):
            break
    return w, losses
