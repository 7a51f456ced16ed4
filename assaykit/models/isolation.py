"""Isolation forest: trees are built in parallel from small hash samples, all rows are scored in one pass."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.ordering import exact_quantiles
from assaykit.operators.sums import balanced
from assaykit.table import c

EULER = 0.5772156649015329


def _path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _build(x: np.ndarray, columns: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """Rows of (feature, cut, left, right, depth value)."""
    nodes = [[-1.0, 0.0, -1.0, -1.0, 0.0]]
    stack = [(0, np.arange(len(x)), 0)]
    while stack:
        node, rows, depth = stack.pop()
        part = x[rows]
        movable = [j for j in columns if len(rows) > 1 and part[:, j].max() > part[:, j].min()]
        if depth >= limit or not movable:
            nodes[node][4] = depth + float(_path(len(rows)))
            continue
        j = int(rng.choice(movable))
        cut = rng.uniform(part[:, j].min(), part[:, j].max())
        goes = part[:, j] <= cut
        nodes += [[-1.0, 0.0, -1.0, -1.0, 0.0], [-1.0, 0.0, -1.0, -1.0, 0.0]]
        left, right = len(nodes) - 2, len(nodes) - 1
        nodes[node][:4] = [float(j), float(cut), float(left), float(right)]
        stack += [(left, rows[goes], depth + 1), (right, rows[~goes], depth + 1)]
    return nodes


@dataclass(frozen=True)
class IsolationForest:
    features: tuple[str, ...]
    trees: tuple
    sample: int
    edge: float

    def depths(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            f = t[:, 0].astype(int)
            while True:
                rows = np.flatnonzero(f[node] >= 0)
                if not len(rows):
                    break
                at = node[rows]
                goes = x[rows, f[at]] <= t[at, 1]
                node[rows] = np.where(goes, t[at, 2], t[at, 3]).astype(np.int64)
            total += t[node, 4]
        return total / len(self.trees)

    def score(self, df: DataFrame) -> DataFrame:
        from pyspark.sql.functions import pandas_udf

        forest = self
        norm = float(_path(self.sample)) or 1.0

        @pandas_udf("double")
        def anomaly(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([col.to_numpy(dtype=float) for col in cols])
            return pd.Series(2.0 ** (-forest.depths(x) / norm))

        return df.withColumn("anomaly_score", anomaly(*[c(f).cast("double") for f in self.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("is_abnormal", F.when(F.col("anomaly_score") > F.lit(self.edge), -1).otherwise(1))


def isolation_forest(
    df: DataFrame, features: Sequence[str], row_id: str, trees: int = 100, max_samples: int | str = "auto", contamination: float | str = "auto",
    max_features: float = 1.0, bootstrap: bool = False, seed: int = 42,
) -> IsolationForest:
    """``contamination="auto"`` marks scores above 0.5; a share puts the edge at that quantile of the scores."""
    n = df.count()
    size = min(256, n) if max_samples == "auto" else min(int(max_samples), n)
    share = min(1.0, (size + 6 * math.sqrt(size) + 10) / n)
    d = len(features)
    span = 2**40
    # a row looks up all its trees at once; only the sampled (row, tree) pairs are kept
    draw = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), F.pmod(F.xxhash64(c(row_id), t, F.lit(seed)), F.lit(span)).alias("h")
    ))
    picked = df.select(F.explode(F.filter(draw, lambda s: s["h"] < int(share * span))).alias("s"), *[c(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    picked = picked.select("s.tree", "s.h", *[f"x{i}" for i in range(d)])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = pdf.sort_values("h", kind="stable")[[f"x{i}" for i in range(d)]].to_numpy()[:size]
        if bootstrap:
            x = x[rng.integers(0, len(x), len(x))]
        columns = np.sort(rng.permutation(d)[: max(1, int(max_features * d))])
        nodes = _build(x, columns, rng, math.ceil(math.log2(max(size, 2))))
        return pd.DataFrame({"tree": [tree], "nodes": [[v for node in nodes for v in node]]})

    rows = picked.groupBy("tree").applyInPandas(grow, "tree int, nodes array<double>").orderBy("tree").collect()
    forest = IsolationForest(tuple(features), tuple(np.array(r["nodes"]).reshape(-1, 5) for r in rows), size, 0.5)
    if contamination == "auto":
        return forest
    # the quantile reads the scores several times, so the score column alone is kept
    scores = forest.score(balanced(df.select(*[c(f) for f in features]))).select("anomaly_score").persist()
    edge = exact_quantiles(scores, ["anomaly_score"], [1 - contamination])["anomaly_score"][0]
    scores.unpersist()
    return IsolationForest(forest.features, forest.trees, size, float(edge))
