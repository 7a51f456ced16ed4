"""Univariate feature scores (regression F, ANOVA F) and the choice of the k best."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.table import c, long_form


def f_regression(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """F = r^2 / (1 - r^2) * (n - 2) per feature, one pass."""
    aggs = []
    for i, n in enumerate(features):
        x, y = c(n).cast("double"), c(target).cast("double")
        aggs += [F.corr(x, y).alias(f"r_{i}"), F.regr_count(y, x).alias(f"n_{i}")]
    out = long_form(df.agg(*aggs), features, {"r": "r_{}", "n": "n_{}"})
    r2 = F.col("r") * F.col("r")
    return out.select("feature", F.try_divide(r2, 1 - r2).alias("_s"), "n").select(
        "feature", (F.col("_s") * (F.col("n") - 2)).alias("score")
    )


def anova_f(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One-way ANOVA F per feature from one grouped aggregate (partial sums per class, then 1 row)."""
    aggs = []
    for i, n in enumerate(features):
        x = c(n).cast("double")
        aggs += [F.count(x).alias(f"n_{i}"), F.avg(x).alias(f"m_{i}"), F.var_pop(x).alias(f"v_{i}")]
    classes = df.groupBy(c(target).alias("_y")).agg(*aggs)
    rows = classes.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"n_{i}").alias("n"), F.col(f"m_{i}").alias("m"), F.col(f"v_{i}").alias("v"))
        for i, n in enumerate(features)
    ])).alias("s")).select("s.*").filter("n > 0")
    # within and between sums from class moments: Var(total) = mean of variances + variance of means
    grand = rows.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    apart = F.col("m") - F.col("grand")
    total = rows.join(F.broadcast(grand), "feature").groupBy("feature").agg(  # one row per feature
        F.count("*").alias("k"), F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * apart * apart).alias("between"),
    )
    score = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return total.filter("k > 1").select("feature", score.alias("score"))


def select_k_best(df: DataFrame, features: Sequence[str], target: str, k: int, task: str) -> list[str]:
    """Names of the k best features in their original order; score ties keep the earlier name."""
    scores = f_regression(df, features, target) if task == "regression" else anova_f(df, features, target)
    best = [r["feature"] for r in scores.orderBy(F.desc_nulls_last("score"), "feature").limit(k).collect()]
    return [n for n in features if n in best]


def select_for_targets(df: DataFrame, features: Sequence[str], targets: Sequence[str], k: int, task: str) -> list[str]:
    """Several targets keep every feature: univariate scores are not defined for them."""
    return list(features) if len(targets) != 1 else select_k_best(df, features, targets[0], k, task)
