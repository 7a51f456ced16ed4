"""Seeded hyper-parameter search and the run over all models of a task."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators import evaluate
from assaykit.operators.split import random_split, stratified_split
from assaykit.plans.models import MENU, Entry, as_code, models_for, primary_metric
from assaykit.sources.tracking import leaderboard, short_error
from assaykit.table import c

TRIALS = 20
NETWORK_TRIALS = 8


def network_settings(seed: int = 42, trials: int = NETWORK_TRIALS) -> list[dict]:
    """Three hidden layers of seeded sizes (1..19, 1..29, 1..19)."""
    rng = random.Random(seed)
    return [{"hidden": (rng.randrange(1, 20), rng.randrange(1, 30), rng.randrange(1, 20))} for _ in range(trials)]


def draw_settings(entry: Entry, trials: int = TRIALS, seed: int = 42) -> list[dict]:
    """Different random settings of a model's space, the same for the same seed."""
    if not entry.searchable or not entry.space:
        return [{}]
    if entry.name == "mlp":
        return network_settings(seed, min(trials, NETWORK_TRIALS))
    rng = random.Random(seed)
    seen, out = set(), []
    for _ in range(trials * 5):
        setting = {k: rng.choice(v) for k, v in entry.space.items()}
        key = tuple(sorted((k, str(v)) for k, v in setting.items()))
        if key not in seen:
            seen.add(key)
            out.append(setting)
        if len(out) == trials:
            break
    return out


def model_score(predicted: DataFrame, task: str, target: str) -> float | None:
    if task == "regression":
        return evaluate.regression_scores(predicted, target, "prediction").first()["r2"]
    scored = as_code(predicted).withColumn("_y", c(target).cast("long"))
    return evaluate.classification_scores(scored, "_y", "prediction", "micro").first()["accuracy"]


def search(
    train: DataFrame, entry: Entry, features: Sequence[str], target: str, row_id: str, trials: int = TRIALS, seed: int = 42,
    validation: float = 0.2,
) -> tuple[dict, DataFrame]:
    """Best setting on a validation part of the training rows, and the table of all trials."""
    split = random_split(train, row_id, validation, seed) if entry.task == "regression" else stratified_split(train, row_id, target, validation, seed)
    frame = split.select(c(row_id), *[c(f) for f in features], c(target), "split").persist()
    rows = []
    try:
        fit_on, check_on = frame.filter("split = 'train'"), frame.filter("split = 'test'")
        for i, setting in enumerate(draw_settings(entry, trials, seed)):
            predict = entry.fit(fit_on, features, target, row_id, **setting)
            rows.append((i, str(setting), model_score(predict(check_on), entry.task, target), setting))
    finally:
        frame.unpersist()
    best = max(rows, key=lambda r: (r[2] if r[2] is not None else float("-inf"), -r[0]))
    table = train.sparkSession.createDataFrame([r[:3] for r in rows], f"trial int, setting string, {primary_metric(entry.task)} double")
    return best[3], table


def library_search(estimator, grid: dict, evaluator, train: DataFrame, folds: int | None = None, parallelism: int = 4, seed: int = 42):
    """Grid search of an MLlib estimator, by folds or by one validation split."""
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(param, values)
    maps = builder.build()
    if folds:
        return CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, parallelism=parallelism, seed=seed).fit(train)
    return TrainValidationSplit(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, trainRatio=0.8, parallelism=parallelism, seed=seed).fit(train)


def run_all(
    train: DataFrame, test: DataFrame, task: str, features: Sequence[str], target: str, row_id: str, names: Sequence[str] | None = None,
    settings: dict[str, dict] | None = None, tune: bool = False, trials: int = TRIALS,
) -> DataFrame:
    """Fit every model of a task on one cached table; a failing model becomes a row, not an end."""
    chosen = [MENU[(task, n)] for n in names] if names else models_for(task)
    columns = [c(row_id), *[c(f) for f in features], c(target)]
    left, right = train.select(*columns).persist(), test.select(*columns).persist()
    results = []
    try:
        for entry in chosen:
            try:
                setting = dict((settings or {}).get(entry.name, {}))
                if tune and entry.searchable:
                    setting |= search(left, entry, features, target, row_id, trials)[0]
                predict = entry.fit(left, features, target, row_id, **setting)
                results.append({"model": entry.name, "state": "succeeded", "metric": model_score(predict(right), task, target)})
            except Exception as error:  # noqa: BLE001 - one model must not stop the others
                results.append({"model": entry.name, "state": "failed", "error": short_error(error)})
    finally:
        left.unpersist()
        right.unpersist()
    return leaderboard(train.sparkSession, results).orderBy(F.desc_nulls_last("metric"), "model")
