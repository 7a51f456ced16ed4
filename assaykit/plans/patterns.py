"""Runs without a target: clustering, decomposition and anomaly detection on a checked, prepared table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.models import cluster, decompose
from assaykit.models.density import dbscan, mean_shift
from assaykit.models.isolation import isolation_forest
from assaykit.models.knn import local_outlier_factor
from assaykit.operators import checks
from assaykit.plans.preparation import Preparation
from assaykit.sources.tracking import leaderboard, short_error
from assaykit.table import TableSpec, c

Fit = Callable[..., DataFrame]

# every entry takes (table, features, row id, settings) and returns one row per table row
PATTERNS: dict[tuple[str, str], Fit] = {
    ("clustering", "kmeans"): lambda d, f, r, **k: cluster.kmeans(d, f, row_id=r, **k).transform(d).select(c(r), "cluster"),
    ("clustering", "dbscan"): lambda d, f, r, **k: dbscan(d, f, r, **k),
    ("clustering", "optics"): lambda d, f, r, **k: cluster.optics(d, f, r, **k),
    ("clustering", "agglomerative"): lambda d, f, r, **k: cluster.agglomerative(d, f, r, **k),
    ("clustering", "affinity_propagation"): lambda d, f, r, **k: cluster.affinity_propagation(d, f, r, **k),
    ("clustering", "mean_shift"): lambda d, f, r, **k: mean_shift(d, f, r, **k)[0],
    ("decomposition", "pca"): lambda d, f, r, k=2: _coordinates(decompose.pca(d, f, k).transform(d), d, r),
    ("decomposition", "mds"): lambda d, f, r, **k: decompose.landmark_mds(d, f, r, **k)[0],
    ("decomposition", "tsne"): lambda d, f, r, **k: decompose.landmark_tsne(d, f, r, **k),
    ("anomaly", "isolation_forest"): lambda d, f, r, **k: isolation_forest(d, f, r, **k).transform(d).select(c(r), "anomaly_score", "is_abnormal"),
    ("anomaly", "local_outlier_factor"): lambda d, f, r, **k: local_outlier_factor(d, f, r, **k),
}


def _coordinates(out: DataFrame, before: DataFrame, row_id: str) -> DataFrame:
    return out.select(c(row_id), *[c(n) for n in out.columns if n not in before.columns])


@dataclass(frozen=True)
class PatternRun:
    """One run of a task without a target; preparation and model see all rows."""

    spec: TableSpec
    task: str
    model: str
    preparation: Preparation

    def run(self, df: DataFrame, **settings) -> DataFrame:
        rules = checks.training_rules(TableSpec(self.spec.row_id, self.spec.features), allow_missing=self.preparation.impute is not None)
        checks.require_clean(checks.check_rows(df, rules, self.spec.row_id))
        prep = self.preparation.fit(df)
        return PATTERNS[(self.task, self.model)](prep.transform(df), prep.features, self.spec.row_id, **settings)


def run_all_patterns(df: DataFrame, spec: TableSpec, task: str, preparation: Preparation, settings: dict[str, dict], names: Sequence[str] | None = None) -> DataFrame:
    """Every model of a task; the metric is the number of rows it describes, and a failing model becomes a row."""
    results = []
    for name in names or [n for t, n in PATTERNS if t == task]:
        try:
            n = PatternRun(spec, task, name, preparation).run(df, **settings.get(name, {})).agg(F.count("*").alias("n")).first()["n"]
            results.append({"model": name, "state": "succeeded", "metric": float(n)})
        except Exception as error:  # noqa: BLE001 - one model must not stop the others
            results.append({"model": name, "state": "failed", "error": short_error(error)})
    return leaderboard(df.sparkSession, results).orderBy(F.desc_nulls_last("metric"), "model")
