"""Explanation and diagram tables: permutation importance, decision regions, scatter and cell tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.pairing import number_rows
from assaykit.table import c, drop_shuffles, hash_uniform


def permutation_importance(
    df: DataFrame, features: Sequence[str], row_id: str, predict: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame],
    metric: str, repeats: int = 10, seed: int = 42,
) -> DataFrame:
    """(feature, repeat, drop): loss of ``metric`` when one feature takes another row's value.

    Rows get a dense number in hash order once; repeat r pairs row i with row (a_r i + b_r) mod n, a bijection.
    All features of a repeat share its pairs, and what it sent is dropped before the next one. The row id is kept only
    where the prediction or the score reads it.
    """
    spark, names = df.sparkSession, [name for name in df.columns if name != row_id]
    try:
        score(predict(df.select(*[c(name) for name in names])))
    except AnalysisException:
        names = df.columns
    base = number_rows(df, [hash_uniform(seed, row_id), F.xxhash64(c(row_id)), *[c(f) for f in features]], names)
    n, drops = base.n, []
    whole = score(predict(base.rows())).select(F.col(metric).cast("double").alias("whole")).first()["whole"]
    for r in range(repeats):
        drop_shuffles(spark)
        step = next(a for a in range(max(2, int(n * (0.381966 + 0.05 * r))) % max(n, 2) or 1, 2 * n + 2) if math.gcd(a, n) == 1)
        paired, out = base.paired(features, step, 1 + (r * 7919) % max(n, 1)), None
        for j, f in enumerate(features):
            swapped = paired.withColumn(f, F.col(f"_o{j}")).select(*[c(name) for name in names])
            one = score(predict(swapped)).select(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), (F.lit(whole) - F.col(metric)).cast("double").alias("drop"))
            out = one if out is None else out.unionByName(one)
        drops += [tuple(row) for row in out.collect()]  # one row a feature
    base.remove()
    return spark.createDataFrame(drops, "feature string, repeat int, drop double")


def importance_summary(drops: DataFrame) -> DataFrame:
    return drops.groupBy("feature").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"))


def decision_regions(df: DataFrame, x: str, y: str, predict: Callable[[DataFrame], DataFrame], size: int = 50) -> DataFrame:
    """Prediction on a size x size grid over the range of two features."""
    b = df.agg(F.min(c(x)).alias("x0"), F.max(c(x)).alias("x1"), F.min(c(y)).alias("y0"), F.max(c(y)).alias("y1")).first()
    i, j = F.col("id") % size, F.floor(F.col("id") / size)
    grid = df.sparkSession.range(size * size).select(
        "id", (F.lit(b["x0"]) + i * F.lit((b["x1"] - b["x0"]) / (size - 1))).alias(x), (F.lit(b["y0"]) + j * F.lit((b["y1"] - b["y0"]) / (size - 1))).alias(y)
    )
    return predict(grid)


def scatter_table(df: DataFrame, row_id: str, axes: Sequence[str], label: str | None = None) -> DataFrame:
    """The points of a 2-D or 3-D diagram, with their label."""
    return df.select(c(row_id), *[c(a) for a in axes], *([c(label).alias("label")] if label else []))


def cell_table(df: DataFrame, x: str, y: str, cells: int = 50, value: str | None = None) -> DataFrame:
    """Counts (and mean value) per cell of an equal-width grid: the heat-map table at any row count."""
    b = df.agg(F.min(c(x)).alias("x0"), F.max(c(x)).alias("x1"), F.min(c(y)).alias("y0"), F.max(c(y)).alias("y1")).first()

    def cell(name: str, lo: float, hi: float):
        step = ((hi - lo) or 1.0) / cells
        return F.least(F.floor((c(name) - F.lit(lo)) / F.lit(step)), F.lit(cells - 1)).cast("long")

    known = df.filter(c(x).isNotNull() & c(y).isNotNull())
    aggs = [F.count("*").alias("n")] + ([F.avg(c(value)).alias("mean_value")] if value else [])
    return known.groupBy(cell(x, b["x0"], b["x1"]).alias("i"), cell(y, b["y0"], b["y1"]).alias("j")).agg(*aggs)
