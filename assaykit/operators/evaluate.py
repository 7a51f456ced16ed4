"""Score tables for fitted models: every figure comes from one small grouped count or moment sum."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.ordering import running_totals
from assaykit.operators.sums import balanced
from assaykit.table import c

AVERAGES = ("binary", "micro", "macro", "weighted")


def regression_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """RMSE, MSE, MAE, R2 and explained variance in one pass."""
    y, e = c(actual).cast("double"), c(actual).cast("double") - c(predicted).cast("double")
    row = df.agg(
        F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop(e).alias("ve"), F.var_pop(F.when(e.isNotNull(), y)).alias("vy"),
    )
    return row.select(
        "n", F.sqrt("mse").alias("rmse"), "mse", "mae",
        (1 - F.try_divide(F.col("mse"), F.col("vy"))).alias("r2"),
        (1 - F.try_divide(F.col("ve"), F.col("vy"))).alias("explained_variance"),
    )


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(c(actual).alias("actual"), c(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: Sequence) -> DataFrame:
    """Rows are true classes, columns predicted classes; classes without rows stay as zeros."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[actual]
    known = spark.createDataFrame([(v,) for v in classes], f"actual {kind}")
    wide = df.groupBy(c(actual).alias("actual")).pivot(predicted, list(classes)).count()
    wide = wide.select("actual", *[F.col(f"`{v}`").alias(f"predicted_{v}") for v in classes])
    return known.join(wide, "actual", "left").na.fill(0)


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class (0 where a denominator is 0)."""
    counts = confusion_counts(df, actual, predicted)
    cells = counts.select(F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("hit")),
    )).alias("s")).select("s.*")
    sums = cells.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("called").cast("double")), zero)
    recall = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("support").cast("double")), zero)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), (F.col("called") + F.col("support")).cast("double")), zero)
    return sums.select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "called", "hit"
    )


def classification_scores(
    df: DataFrame, actual: str, predicted: str, average: str | None = None, positive=1, n_classes: int | None = None
) -> DataFrame:
    """Accuracy, precision, recall and F1; the default average is binary for two classes, else weighted."""
    report = class_report(df, actual, predicted)
    n = F.sum("support").cast("double")
    base = [F.try_divide(F.sum("hit").cast("double"), n).alias("accuracy")]
    if average is None:
        if n_classes is None:
            n_classes = report.filter("support > 0").count()
        average = "binary" if n_classes == 2 else "weighted"
    if average == "binary":
        if (report.filter("support > 0").count() if n_classes is None else n_classes) > 2:
            raise ValueError("a binary average needs two classes")
        pick = F.col("class") == F.lit(positive)
        parts = [F.coalesce(F.max(F.when(pick, F.col(k))), F.lit(0.0)).alias(k) for k in ("precision", "recall", "f1")]
    elif average == "micro":
        parts = [F.try_divide(F.sum("hit").cast("double"), n).alias(k) for k in ("precision", "recall", "f1")]
    elif average == "macro":
        parts = [F.avg(k).alias(k) for k in ("precision", "recall", "f1")]
    elif average == "weighted":
        parts = [F.try_divide(F.sum(F.col(k) * F.col("support")), n).alias(k) for k in ("precision", "recall", "f1")]
    else:
        raise ValueError(f"average must be one of {AVERAGES}")
    return report.agg(*base, *parts).withColumn("average", F.lit(average))


def report_averages(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The macro and weighted lines under a class report."""
    report = class_report(df, actual, predicted)
    n = F.sum("support").cast("double")
    wide = report.agg(
        *[F.avg(k).alias(f"m_{k}") for k in ("precision", "recall", "f1")],
        *[F.try_divide(F.sum(F.col(k) * F.col("support")), n).alias(f"w_{k}") for k in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )
    rows = [
        F.struct(F.lit(name).alias("class"), *[F.col(f"{p}_{k}").alias(k) for k in ("precision", "recall", "f1")], F.col("support"))
        for name, p in (("macro avg", "m"), ("weighted avg", "w"))
    ]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def threshold_table(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """TP, FP, FN, TN with precision, recall, FPR and TPR at every distinct score (>= threshold is positive).

    Rows are first counted per distinct score, so the ordering work depends on distinct scores only.
    """
    hit = (c(actual) == F.lit(positive)).cast("long")
    base = df.select(c(score).cast("double").alias("threshold"), hit.alias("_p"), (1 - hit).alias("_q"))
    ranked = running_totals(base, "threshold", {"pos": F.sum("_p"), "neg": F.sum("_q")}, descending=True)
    totals = base.filter("threshold is not null").agg(F.sum("_p").alias("p"), F.sum("_q").alias("q")).first()
    p, n = float(totals["p"] or 0), float(totals["q"] or 0)
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    out = ranked.select("threshold", tp.alias("tp"), fp.alias("fp"))
    return out.select(
        "threshold", "tp", "fp", (F.lit(int(p)) - F.col("tp")).alias("fn"), (F.lit(int(n)) - F.col("fp")).alias("tn"),
        F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.lit(p)).alias("recall"),
        F.try_divide(F.col("fp").cast("double"), F.lit(n)).alias("fpr"),
    )


def roc_auc(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """Area under the ROC curve as the rank statistic: ties count one half."""
    hit = (c(actual) == F.lit(positive)).cast("long")
    base = df.select(c(score).cast("double").alias("threshold"), hit.alias("_p"), (1 - hit).alias("_q"))
    ranked = running_totals(base, "threshold", {"pos": F.sum("_p"), "neg": F.sum("_q")})
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.agg(
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    )


def average_precision(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    table = threshold_table(df, actual, score, positive)
    total = F.col("tp") + F.col("fn")
    gained = running_totals(
        df.select(c(score).cast("double").alias("threshold"), (c(actual) == F.lit(positive)).cast("long").alias("_p")),
        "threshold", {"pos": F.sum("_p")}, descending=True,
    ).select("threshold", "pos")
    return table.join(gained, "threshold").agg(
        F.sum(F.col("precision") * F.col("pos") / total).alias("average_precision")
    )


def require_binary(n_classes: int) -> None:
    """Threshold curves need exactly two classes in the whole data set."""
    if n_classes != 2:
        raise ValueError(f"threshold curves are defined for two classes, the data has {n_classes}")


def cross_validate(
    df: DataFrame, fold: str, folds: int, fit_predict: Callable[[DataFrame, DataFrame], DataFrame],
    score: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Fit on all folds but one, score the one left out; one row per fold."""
    frame = balanced(df).persist()  # read 2 * folds times
    rows = []
    try:
        for k in range(folds):
            predicted = fit_predict(frame.filter(c(fold) != k), frame.filter(c(fold) == k))
            rows.append({**score(predicted).first().asDict(), "fold": k})
    finally:
        frame.unpersist()
    return df.sparkSession.createDataFrame(pd.DataFrame(rows))


def fold_summary(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population std over folds."""
    cells = []
    aggs = list(itertools.chain.from_iterable(
        (F.avg(m).alias(f"m{i}"), F.stddev_pop(m).alias(f"s{i}")) for i, m in enumerate(metrics)
    ))
    for i, m in enumerate(metrics):
        cells.append(F.struct(F.lit(m).alias("metric"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")))
    return scores.agg(*aggs).select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def residual_table(df: DataFrame, row_id: str, actual: str, predicted: str) -> DataFrame:
    return df.select(
        c(row_id), c(actual).alias("actual"), c(predicted).alias("predicted"), (c(predicted) - c(actual)).alias("residual")
    )


def calinski_harabasz(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Between/within dispersion ratio from the moments of each cluster."""
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(features):
        aggs += [F.avg(c(f).cast("double")).alias(f"m{i}"), F.var_pop(c(f).cast("double")).alias(f"v{i}")]
    groups = df.groupBy(c(label).alias("k")).agg(*aggs)
    within = sum((F.col("n") * F.col(f"v{i}") for i in range(len(features))), F.lit(0.0))
    sums = groups.agg(
        F.count("*").alias("k"), F.sum("n").cast("double").alias("n"), F.sum(within).alias("within"),
        *[F.sum(F.col("n") * F.col(f"m{i}")).alias(f"s{i}") for i in range(len(features))],
        *[F.sum(F.col("n") * F.col(f"m{i}") * F.col(f"m{i}")).alias(f"q{i}") for i in range(len(features))],
    )
    between = sum(
        (F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col("n") for i in range(len(features))), F.lit(0.0)
    )
    score = F.try_divide(between * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    return sums.select("k", F.col("n").cast("long").alias("n"), score.alias("calinski_harabasz"))


def squared_silhouette(df: DataFrame, features: Sequence[str], label: str, row_id: str) -> DataFrame:
    """Silhouette with squared Euclidean distance, exact from cluster moments: no pair of rows is formed.

    mean_j |x - y_j|^2 over a cluster = |x|^2 - 2 x.m + q with the cluster mean m and mean square q, so a
    row needs the moments of each cluster only; they enter as literals and the table is not shuffled.
    """
    groups = cluster_moments(df, features, label)
    if len(groups) < 2:
        raise ValueError("a silhouette needs at least two clusters")
    norm = sum((c(f).cast("double") * c(f).cast("double") for f in features), F.lit(0.0))
    cells = []
    for g in groups:
        dot = sum((c(f).cast("double") * F.lit(g[f"m{i}"]) for i, f in enumerate(features)), F.lit(0.0))
        cells.append(F.struct(
            F.greatest(norm - 2 * dot + F.lit(g["qq"]), F.lit(0.0)).alias("d"), F.lit(g["n"]).alias("n"),
            (c(label) == F.lit(g["_k"])).alias("own"),
        ))
    own = F.filter("_cells", lambda s: s["own"])[0]
    other = F.array_min(F.transform(F.filter("_cells", lambda s: ~s["own"]), lambda s: s["d"]))
    base = df.select(c(row_id).alias(row_id), c(label).alias(label), F.array(*cells).alias("_cells")).select(
        row_id, label, own.alias("_own"), other.alias("b")
    )
    a = F.try_divide(F.col("_own.d") * F.col("_own.n"), F.col("_own.n").cast("double") - 1)
    s = F.coalesce(F.try_divide(F.col("b") - a, F.greatest(a, F.col("b"))), F.lit(0.0))
    return base.select(row_id, label, s.alias("silhouette"))


def cluster_moments(df: DataFrame, features: Sequence[str], label: str, limit: int = 500) -> list:
    """Count, mean and mean square of each cluster; the number of clusters is checked."""
    squares = sum((c(f).cast("double") * c(f).cast("double") for f in features), F.lit(0.0))
    groups = df.groupBy(c(label).alias("_k")).agg(
        F.count("*").alias("n"), F.avg(squares).alias("qq"),
        *[F.avg(c(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)],
    )
    rows = groups.orderBy("_k").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} clusters")
    return rows
