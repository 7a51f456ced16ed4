"""PCA, landmark MDS and landmark t-SNE with their diagram tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.neighbors import distances
from assaykit.table import c, features_array

LANDMARK_LIMIT = 2000


@dataclass(frozen=True)
class PcaModel:
    features: tuple[str, ...]
    means: tuple[float, ...]
    components: np.ndarray
    ratio: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add the scores PC1.. as column math."""
        out = []
        for k in range(self.components.shape[1]):
            score = F.lit(0.0)
            for j, f in enumerate(self.features):
                score = score + (c(f) - F.lit(self.means[j])) * F.lit(float(self.components[j, k]))
            out.append(score.alias(f"PC{k + 1}"))
        return df.select("*", *out)

    def loadings(self, spark) -> DataFrame:
        rows = [(f, k + 1, float(self.components[j, k]), float(self.ratio[k])) for j, f in enumerate(self.features) for k in range(len(self.ratio))]
        return spark.createDataFrame(rows, "feature string, component int, loading double, explained_ratio double")


def pca(df: DataFrame, features: Sequence[str], k: int = 2) -> PcaModel:
    """Centred PCA; the largest loading of each component is positive."""
    row = df.agg(*[F.avg(c(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    means = tuple(float(row[f"m{i}"]) for i in range(len(features)))
    centred = df.select(*[(c(f) - F.lit(m)).alias(f"x{i}") for i, (f, m) in enumerate(zip(features, means))])
    wide = VectorAssembler(inputCols=centred.columns, outputCol="v").transform(centred).select("v")
    model = PCA(k=k, inputCol="v", outputCol="s").fit(wide)
    parts = model.pc.toArray()
    signs = np.sign(parts[np.abs(parts).argmax(axis=0), np.arange(k)])
    return PcaModel(tuple(features), means, parts * signs, tuple(float(v) for v in model.explainedVariance.toArray()))


def biplot(model: PcaModel, df: DataFrame, row_id: str, axes: Sequence[int] = (1, 2)) -> DataFrame:
    """Scores of two or three components divided by their range, to be drawn with the loadings."""
    scored = model.transform(df)
    names = [f"PC{a}" for a in axes]
    bounds = scored.agg(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).first()
    return scored.select(c(row_id), *[
        (F.col(n) / F.lit((bounds[f"hi_{n}"] - bounds[f"lo_{n}"]) or 1.0)).alias(n) for n in names
    ])


def _landmarks(df: DataFrame, features: Sequence[str], row_id: str, count: int) -> np.ndarray:
    if not 2 <= count <= LANDMARK_LIMIT:
        raise ValueError(f"landmarks must be 2..{LANDMARK_LIMIT}")
    rows = df.select(features_array(features).alias("_f"), F.xxhash64(c(row_id)).alias("_h")).orderBy("_h").limit(count)
    return np.stack(rows.toPandas()["_f"].to_numpy())


def landmark_mds(df: DataFrame, features: Sequence[str], row_id: str, landmarks: int, k: int = 2) -> tuple[DataFrame, float]:
    """Classical scaling of a bounded landmark set; all rows are placed from their landmark distances.

    Returns the coordinates and the raw stress over landmark pairs.
    """
    z = _landmarks(df, features, row_id, landmarks)
    d2 = distances(z, z) ** 2
    centre = np.eye(len(z)) - 1.0 / len(z)
    values, vectors = np.linalg.eigh(-0.5 * centre @ d2 @ centre)
    top = np.argsort(values)[::-1][:k]
    signs = np.sign(vectors[np.abs(vectors[:, top]).argmax(axis=0), top])
    root = np.sqrt(np.maximum(values[top], 1e-12))
    place = (vectors[:, top] * signs / root).T
    mean = d2.mean(axis=0)
    y = -0.5 * (place @ (d2 - mean[:, None])).T
    stress = float(((distances(y, y) - np.sqrt(d2)) ** 2).sum() / 2)

    def put(x: np.ndarray) -> np.ndarray:
        return -0.5 * (distances(x, z) ** 2 - mean[None, :]) @ place.T

    return _place(df, features, row_id, put, k, "MDS"), stress


def _place(df, features, row_id, put, k, prefix) -> DataFrame:
    base = df.select(c(row_id).alias(row_id), features_array(features).alias("_f"))
    kind = dict(base.dtypes)[row_id]
    names = [f"{prefix}{j + 1}" for j in range(k)]

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), 4096):
                part = pdf.iloc[start : start + 4096]
                y = put(np.stack(part["_f"].to_numpy()))
                yield pd.DataFrame({row_id: part[row_id], **{n: y[:, j] for j, n in enumerate(names)}})

    return base.mapInPandas(run, f"`{row_id}` {kind}, " + ", ".join(f"{n} double" for n in names))


def _affinities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Row-wise Gaussian weights with the wanted entropy (bisection on the precision)."""
    n = len(d2)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    off = ~np.eye(n, dtype=bool)
    for _ in range(60):
        p = np.exp(-d2 * beta[:, None]) * off
        total = np.maximum(p.sum(axis=1), 1e-300)
        entropy = np.log(total) + beta * (d2 * p).sum(axis=1) / total
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return p / total[:, None]


def landmark_tsne(
    df: DataFrame, features: Sequence[str], row_id: str, landmarks: int, k: int = 2, perplexity: float = 30.0, learning_rate: float | str = "auto",
    n_iter: int = 1000, early_exaggeration: float = 12.0, near: int = 5,
) -> DataFrame:
    """t-SNE of a bounded landmark set; every other row is put at the weighted mean of its nearest landmarks."""
    z = _landmarks(df, features, row_id, landmarks)
    n = len(z)
    perplexity = min(perplexity, max(2.0, (n - 1) / 3))
    p = _affinities(distances(z, z) ** 2, perplexity)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    rate = max(n / early_exaggeration / 4, 50.0) if learning_rate == "auto" else float(learning_rate)
    centred = z - z.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    y = u[:, :k] * s[:k]
    y = y / max(y[:, 0].std(), 1e-12) * 1e-4
    speed, gains = np.zeros_like(y), np.ones_like(y)
    early = min(250, n_iter // 4)
    for step in range(n_iter):
        q = 1.0 / (1.0 + distances(y, y) ** 2)
        np.fill_diagonal(q, 0.0)
        weight = ((early_exaggeration if step < early else 1.0) * p - np.maximum(q / q.sum(), 1e-12)) * q
        grad = 4 * (weight.sum(axis=1)[:, None] * y - weight @ y)
        gains = np.maximum(np.where(np.sign(grad) != np.sign(speed), gains + 0.2, gains * 0.8), 0.01)
        speed = (0.5 if step < early else 0.8) * speed - rate * gains * grad
        y = y + speed

    def put(x: np.ndarray) -> np.ndarray:
        d = distances(x, z)
        best = np.argsort(d, axis=1, kind="stable")[:, :near]
        w = 1.0 / (np.take_along_axis(d, best, axis=1) + 1e-12)
        return (w[:, :, None] * y[best]).sum(axis=1) / w.sum(axis=1)[:, None]

    return _place(df, features, row_id, put, k, "TSNE")
