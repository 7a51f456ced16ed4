"""Logistic regression on MLlib with the C / penalty / class-weight parameters of the workflow."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.split import class_counts
from assaykit.table import c


@dataclass(frozen=True)
class LogisticModel:
    features: tuple[str, ...]
    model: object
    classes: tuple[int, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``probability`` (array by class code)."""
        from pyspark.ml.functions import vector_to_array

        wide = VectorAssembler(inputCols=list(self.features), outputCol="_v", handleInvalid="keep").transform(df)
        out = self.model.transform(wide)
        return out.withColumn("probability", vector_to_array("probability")).drop("_v", "rawPrediction")

    def coefficients(self, spark) -> DataFrame:
        """(class, feature, coefficient) sorted by size; two classes have one coefficient set."""
        m = self.model
        rows = m.coefficientMatrix.toArray()
        data = [
            (int(self.classes[k]) if len(rows) > 1 else int(self.classes[-1]), f, float(rows[k][j]), float(m.interceptVector[k]))
            for k in range(len(rows)) for j, f in enumerate(self.features)
        ]
        return spark.createDataFrame(data, "class long, feature string, coefficient double, intercept double").orderBy(
            "class", F.desc(F.abs("coefficient"))
        )

    def formulas(self, digits: int = 3) -> dict[int, str]:
        rows = self.model.coefficientMatrix.toArray()
        out = {}
        for k in range(len(rows)):
            terms = " + ".join(f"{round(float(w), digits)}*{f}" for f, w in zip(self.features, rows[k]))
            label = self.classes[k] if len(rows) > 1 else self.classes[-1]
            out[int(label)] = f"{terms} + {round(float(self.model.interceptVector[k]), digits)}".replace("+ -", "- ")
        return out


def logistic_regression(
    df: DataFrame, features: Sequence[str], target: str, penalty: str | None = "l2", C: float = 1.0, l1_ratio: float = 0.5,
    class_weight: str | None = None, max_iter: int = 100, tol: float = 1e-8,
) -> LogisticModel:
    """min sum log-loss + penalty / C: the library averages the loss, so its strength is 1 / (C n)."""
    frame = df.select(*[c(f).cast("double").alias(f) for f in features], c(target).cast("double").alias("label")).na.drop()
    counts = class_counts(frame, "label")
    n = sum(counts.values())
    ratio = {"l1": 1.0, "l2": 0.0, "elasticnet": l1_ratio, None: 0.0}[penalty]
    settings = dict(maxIter=max_iter, tol=tol, standardization=False, elasticNetParam=ratio, regParam=0.0 if penalty is None else 1.0 / (C * n))
    if class_weight == "balanced":
        w = F.lit(1.0)
        for k, m in counts.items():
            w = F.when(F.col("label") == F.lit(k), F.lit(n / (len(counts) * m))).otherwise(w)
        frame = frame.withColumn("weight", w)
        settings["weightCol"] = "weight"
    wide = VectorAssembler(inputCols=list(features), outputCol="features").transform(frame)
    model = LogisticRegression(featuresCol="features", labelCol="label", **settings).fit(wide)
    model.setFeaturesCol("_v")
    return LogisticModel(tuple(features), model, tuple(int(k) for k in sorted(counts)))
