"""Sums of numpy arrays over all rows: each task adds up its rows, the JVM adds the task arrays in two steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.table import c

FAN_OUT = 64
ROWS_AT_ONCE = 8192


def fan_out(df: DataFrame) -> int:
    """How many intermediate sums are worth a step of their own."""
    # from the session, since counting the partitions of a plan can run its shuffles
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return 1 if parts <= FAN_OUT else FAN_OUT


def balanced(df: DataFrame) -> DataFrame:
    """Spread a table that arrives in fewer pieces than there are cores; iterative fits read it many times."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sum_arrays(df: DataFrame, add: Callable[[pd.DataFrame], np.ndarray], fan: int = 1) -> np.ndarray:
    """Sum of ``add(rows)`` over the table; ``add`` sees at most ROWS_AT_ONCE rows and has a fixed width."""

    def part(batches):
        total = None
        for pdf in batches:
            for start in range(0, len(pdf), ROWS_AT_ONCE):
                one = add(pdf.iloc[start : start + ROWS_AT_ONCE])
                total = one if total is None else total + one
        if total is not None:
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId() % fan], "part": [total]})

    pieces = df.mapInPandas(part, "slot int, part array<double>").select("slot", array_to_vector("part").alias("v"))
    if fan > 1:
        pieces = pieces.groupBy("slot").agg(Summarizer.sum(F.col("v")).alias("v"))
    row = pieces.agg(Summarizer.sum(F.col("v")).alias("v")).first()
    if row["v"] is None or row["v"].size == 0:
        raise ValueError("no rows to fit on")
    return row["v"].toArray()


def training_frame(df: DataFrame, features: Sequence[str], target: str | None = None, weight: str | None = None) -> DataFrame:
    """Only the columns a fit reads, as doubles under neutral names (x0.., y, w), kept in memory or on disk."""
    cols = [c(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    if target is not None:
        cols.append(c(target).cast("double").alias("y"))
    if weight is not None:
        cols.append(c(weight).cast("double").alias("w"))
    return balanced(df.select(*cols).na.drop())


def matrix(pdf: pd.DataFrame, d: int) -> np.ndarray:
    return pdf[[f"x{i}" for i in range(d)]].to_numpy(dtype=float)
