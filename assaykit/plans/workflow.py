"""The whole run: check -> split -> prepare -> train -> score -> score the application table -> persist."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators import checks, evaluate
from assaykit.operators.labels import sorted_labels
from assaykit.operators.split import random_split, stratified_split
from assaykit.operators.sums import balanced
from assaykit.plans.models import MENU, as_code, score_table
from assaykit.plans.preparation import Preparation
from assaykit.plans.search import search
from assaykit.sources.sinks import save_with_identifier
from assaykit.sources.store import save_fitted
from assaykit.sources.tracking import record_run
from assaykit.table import TableSpec, c


@dataclass(frozen=True)
class Workflow:
    spec: TableSpec
    task: str
    model: str
    preparation: Preparation
    settings: dict = field(default_factory=dict)
    tune: bool = False
    trials: int = 20
    test_size: float = 0.2
    seed: int = 42

    def run(self, df: DataFrame) -> WorkflowResult:
        entry = MENU[(self.task, self.model)]
        missing_ok = entry.supports_missing or self.preparation.impute is not None
        rules = checks.training_rules(self.spec, allow_missing=missing_ok)
        checks.require_clean(checks.check_rows(df, rules, self.spec.row_id))
        target = self.spec.targets[0]
        classes: dict[str, tuple] = {}
        if self.task == "classification":
            for t in self.spec.targets:
                order = sorted_labels(df, t).order
                if order != tuple(range(len(order))):
                    # models know the codes 0..K-1; labels come back in the outputs
                    classes[t] = order
                    df = df.withColumn(t, F.array_position(F.array(*[F.lit(v) for v in order]), c(t)) - 1)
            divided = stratified_split(df, self.spec.row_id, target, self.test_size, self.seed)
        else:
            divided = random_split(df, self.spec.row_id, self.test_size, self.seed)
        train, test = divided.filter("split = 'train'"), divided.filter("split = 'test'")
        held = balanced(train).persist()  # every fit below reads it several times
        prep = self.preparation.fit(held)
        ready = prep.transform(held)
        predictors, chosen = {}, {}
        for t in self.spec.targets:
            setting = dict(self.settings)
            if self.tune and entry.searchable:
                setting |= search(ready, entry, prep.features, t, self.spec.row_id, self.trials, self.seed)[0]
            chosen[t] = setting
            predictors[t] = entry.fit(ready, prep.features, t, self.spec.row_id, **setting)
        held.unpersist()
        return WorkflowResult(self, prep, predictors, chosen, train, test, classes)


@dataclass(frozen=True)
class FittedWorkflow:
    """A fitted chain and its models, without the rows they were fitted on; ``classes`` has the labels of coded targets."""

    row_id: str
    prep: object
    predictors: dict
    classes: dict = field(default_factory=dict)

    def score_application(self, df: DataFrame) -> DataFrame:
        """Works on batch and streaming tables; classes come back as their labels."""

        def named(target, predict):
            label = F.get(F.array(*[F.lit(v) for v in self.classes.get(target, ())]), F.col("prediction").cast("int"))
            return lambda rows: predict(rows).withColumn("prediction", label) if target in self.classes else predict(rows)

        predictors = {t: named(t, p) for t, p in self.predictors.items()}
        return score_table(df, self.row_id, self.prep.transform, predictors, list(self.prep.features))


@dataclass(frozen=True)
class WorkflowResult:
    workflow: Workflow
    prep: object
    predictors: dict
    settings: dict
    train: DataFrame
    test: DataFrame
    classes: dict = field(default_factory=dict)

    def predictions(self, part: str = "test", target: str | None = None) -> DataFrame:
        """Rows of a part with ``prediction``, and ``predicted_label`` where classes are not the codes themselves."""
        rows = self.prep.transform(self.test if part == "test" else self.train)
        target = target or self.workflow.spec.targets[0]
        out = self.predictors[target](rows)
        return out.withColumn("predicted_label", self._label(target)) if target in self.classes else out

    def _label(self, target: str):
        return F.get(F.array(*[F.lit(v) for v in self.classes[target]]), F.col("prediction").cast("int"))

    def scores(self) -> DataFrame:
        """One row of scores for each target."""
        out = None
        for target in self.workflow.spec.targets:
            rows = self.predictions(target=target)
            if self.workflow.task == "regression":
                one = evaluate.regression_scores(rows, target, "prediction")
            else:
                one = evaluate.classification_scores(as_code(rows).withColumn("_y", c(target).cast("long")), "_y", "prediction")
            one = one.select(F.lit(target).alias("target"), "*")
            out = one if out is None else out.unionByName(one)
        return out

    def fitted(self) -> FittedWorkflow:
        """What scoring needs: the chain, the models and the labels."""
        return FittedWorkflow(self.workflow.spec.row_id, self.prep, self.predictors, self.classes)

    def score_application(self, df: DataFrame) -> DataFrame:
        """Works on batch and streaming tables; classes come back as their labels."""
        return self.fitted().score_application(df)

    def save(self, path: str) -> str:
        """Store what scoring needs; ``store.load_fitted`` gives a ``FittedWorkflow`` back."""
        return save_fitted(self.train.sparkSession, self.fitted(), path)

    def persist(self, root: str, experiment: str) -> str:
        spark = self.train.sparkSession
        many = len(self.workflow.spec.targets) > 1
        metrics = {
            f"{r['target']}.{k}" if many else k: v for r in self.scores().collect() for k, v in r.asDict().items() if isinstance(v, float)
        }
        run_id = record_run(spark, root, experiment, self.workflow.model, self.settings, metrics)
        for target in self.workflow.spec.targets:
            name = f"test_predictions_{target}" if many else "test_predictions"
            save_with_identifier(self.predictions(target=target), f"{root}/tables/{run_id}/{name}", self.workflow.spec.row_id)
        return run_id
