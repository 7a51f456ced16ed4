"""k-nearest-neighbour regression and classification, and the local outlier factor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.operators.neighbors import nearest_neighbors
from assaykit.operators.ordering import exact_quantiles
from assaykit.table import c, cut_lineage


def _weighted(edges: DataFrame, query_id: str, weights: str) -> DataFrame:
    """Vote weight per neighbour; with distance weights an exact hit takes all of the vote."""
    if weights == "uniform":
        return edges.withColumn("_w", F.lit(1.0))
    hit = F.max((F.col("distance") == 0).cast("int")).over(W.partitionBy(query_id))
    w = F.when(hit == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    return edges.withColumn("_w", w)


def knn_regression(
    train: DataFrame, queries: DataFrame, features: Sequence[str], target: str, row_id: str, k: int = 5,
    weights: str = "uniform", p: float = 2.0,
) -> DataFrame:
    edges = nearest_neighbors(queries, train, features, k, row_id, row_id, p, payload=[target])
    w = _weighted(edges, row_id, weights)
    return w.groupBy(row_id).agg((F.sum(F.col("_w") * c(target)) / F.sum("_w")).alias("prediction"))


def knn_classification(
    train: DataFrame, queries: DataFrame, features: Sequence[str], target: str, row_id: str, k: int = 5,
    weights: str = "uniform", p: float = 2.0,
) -> DataFrame:
    """Weighted vote; equal votes go to the smallest label."""
    edges = nearest_neighbors(queries, train, features, k, row_id, row_id, p, payload=[target])
    votes = _weighted(edges, row_id, weights).groupBy(row_id, c(target).alias("_y")).agg(F.sum("_w").alias("_v"))
    shares = votes.groupBy(row_id).agg(
        F.min_by("_y", F.struct((-F.round("_v", 12)).alias("v"), F.col("_y"))).alias("prediction"),
        (F.max("_v") / F.sum("_v")).alias("probability"),
    )
    return shares


def local_outlier_factor(
    df: DataFrame, features: Sequence[str], row_id: str, k: int = 20, contamination: float | str = "auto", p: float = 2.0,
) -> DataFrame:
    """LOF per row; the row itself is not its own neighbour. ``is_abnormal`` is -1 for outliers, else 1.

    With ``contamination="auto"`` rows with LOF above 1.5 are outliers, otherwise the given share of rows.
    """
    edges = cut_lineage(nearest_neighbors(df, df, features, k, row_id, row_id, p, exclude_self=True))  # read three times
    reach_of = edges.groupBy(row_id).agg(F.max("distance").alias("_kd"))
    joined = edges.join(reach_of.select(c(row_id).alias("neighbor"), "_kd"), "neighbor")
    density = joined.groupBy(row_id).agg(
        (1.0 / (F.avg(F.greatest("distance", "_kd")) + F.lit(1e-10))).alias("_lrd")
    )
    scored = edges.join(density.select(c(row_id).alias("neighbor"), F.col("_lrd").alias("_other")), "neighbor")
    lof = scored.groupBy(row_id).agg(F.avg("_other").alias("_m")).join(density, row_id).select(
        row_id, (F.col("_m") / F.col("_lrd")).alias("lof")
    )
    edge = 1.5 if contamination == "auto" else exact_quantiles(lof, ["lof"], [1 - contamination])["lof"][0]
    return lof.select(
        row_id, "lof", (-F.col("lof")).alias("negative_outlier_factor"),
        F.when(F.col("lof") > F.lit(edge), -1).otherwise(1).alias("is_abnormal"),
    )
