"""MLlib trees and forests with the workflow's parameters, AdaBoost on weighted trees, tree tables."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.table import c, cut_lineage

CUT_EVERY = 5


def _fit(estimator, df: DataFrame, features: Sequence[str], target: str, weight: str | None = None):
    frame = df.withColumn("_label", c(target).cast("double"))
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    return Pipeline(stages=[assembler, estimator]).fit(frame)


def _common(max_depth, min_leaf, seed):
    return dict(featuresCol="_features", labelCol="_label", maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed)


def decision_tree_regression(df, features, target, max_depth=5, min_leaf=1, seed=42):
    return _fit(DecisionTreeRegressor(**_common(max_depth, min_leaf, seed)), df, features, target)


def decision_tree_classification(df, features, target, criterion="gini", max_depth=3, min_leaf=1, seed=42):
    impurity = "gini" if criterion == "gini" else "entropy"  # log_loss is the entropy criterion
    return _fit(DecisionTreeClassifier(impurity=impurity, **_common(max_depth, min_leaf, seed)), df, features, target)


def random_forest_regression(df, features, target, trees=100, max_depth=5, min_leaf=1, max_features="sqrt", bootstrap=True, subsample=1.0, seed=42):
    return _fit(
        RandomForestRegressor(numTrees=trees, featureSubsetStrategy=max_features, bootstrap=bootstrap, subsamplingRate=subsample, **_common(max_depth, min_leaf, seed)),
        df, features, target,
    )


def random_forest_classification(df, features, target, criterion="gini", trees=100, max_depth=4, min_leaf=1, max_features="sqrt", bootstrap=True, subsample=1.0, seed=42):
    impurity = "gini" if criterion == "gini" else "entropy"
    return _fit(
        RandomForestClassifier(
            numTrees=trees, impurity=impurity, featureSubsetStrategy=max_features, bootstrap=bootstrap, subsamplingRate=subsample,
            **_common(max_depth, min_leaf, seed),
        ),
        df, features, target,
    )


def predict(model, df: DataFrame) -> DataFrame:
    """Add ``prediction`` and, for classifiers, ``probability`` as an array."""
    out = model.transform(df.withColumn("_label", F.lit(0.0)))
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array("probability"))
    return out.drop("_features", "_label", "rawPrediction")


def tree_importance(model, features: Sequence[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(features, values)], "feature string, importance double")


def mean_importance(models: Sequence, features: Sequence[str], spark) -> DataFrame:
    """Several targets: the mean over their models."""
    values = sum(m.stages[-1].featureImportances.toArray() for m in models) / len(models)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(features, values)], "feature string, importance double")


def tree_structure(model, features: Sequence[str], spark) -> DataFrame:
    """One row per printed line of the tree: depth, feature, comparison, cut, prediction."""
    rows = []
    for i, line in enumerate(model.stages[-1].toDebugString.splitlines()[1:]):
        depth = len(line) - len(line.lstrip())
        test = re.search(r"\(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        leaf = re.search(r"Predict: ([-\d.eE]+)", line)
        if test or leaf:
            rows.append((
                i, depth, features[int(test.group(1))] if test else None, test.group(2) if test else None,
                float(test.group(3)) if test else None, float(leaf.group(1)) if leaf else None,
            ))
    return spark.createDataFrame(rows, "line int, depth int, feature string, comparison string, cut double, prediction double")


@dataclass(frozen=True)
class AdaBoostModel:
    models: tuple
    votes: tuple[float, ...]
    classes: tuple[int, ...]

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        names = df.columns
        totals = [F.lit(0.0)] * len(self.classes)
        out = df
        for i, (m, v) in enumerate(zip(self.models, self.votes)):
            out = predict(m, out).withColumnRenamed("prediction", f"_p{i}").drop("probability")
            totals = [t + F.when(F.col(f"_p{i}") == float(k), F.lit(v)).otherwise(0.0) for t, k in zip(totals, self.classes)]
        out = out.withColumn("votes", F.array(*totals))
        at = F.array_position("votes", F.array_max("votes")).cast("int")
        return out.withColumn(output, F.element_at(F.array(*[F.lit(k) for k in self.classes]), at)).select(*[c(n) for n in names], "votes", output)


def adaboost(
    df: DataFrame, features: Sequence[str], target: str, classes: Sequence[int], rounds: int = 50, rate: float = 1.0, max_depth: int = 3, seed: int = 42,
) -> AdaBoostModel:
    """Discrete boosting of depth-limited trees (SAMME). Row weights live in a column; lineage is cut every few rounds."""
    frame = df.select(*[c(f).cast("double").alias(f) for f in features], c(target).cast("double").alias("_label"), F.lit(1.0).alias("_w"))
    frame = frame.persist()
    held = frame
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    tree = DecisionTreeClassifier(weightCol="_w", **_common(max_depth, 1, seed))
    models, votes, k = [], [], len(classes)
    for step in range(rounds):
        model = Pipeline(stages=[assembler, tree]).fit(frame)
        out = model.transform(frame).drop("_features", "rawPrediction", "probability")
        wrong = (F.col("prediction") != F.col("_label")).cast("double")
        sums = out.agg(F.sum(wrong * F.col("_w")).alias("e"), F.sum("_w").alias("w")).first()
        error = sums["e"] / sums["w"]
        if error >= 1 - 1 / k:
            break
        vote = rate * (math.log((1 - error) / error) + math.log(k - 1)) if error > 0 else 1.0
        models.append(model)
        votes.append(vote)
        if error <= 0:
            break
        scale = 1.0 / sums["w"]
        frame = out.withColumn("_w", F.col("_w") * F.exp(F.lit(vote) * wrong) * F.lit(scale * 1.0) * F.lit(float(sums["w"]))).drop("prediction")
        if (step + 1) % CUT_EVERY == 0:
            frame = cut_lineage(frame)
    held.unpersist()
    if not models:
        raise ValueError("the first tree is no better than chance")
    return AdaBoostModel(tuple(models), tuple(votes), tuple(classes))
