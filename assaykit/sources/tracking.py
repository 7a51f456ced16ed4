"""Run records as append-only long tables: runs, params, metrics; experiment listings read them back."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "experiment_id string, run_id string, run_name string, status string, start_time timestamp, end_time timestamp"
VALUES = "run_id string, name string, value string"
METRICS = "run_id string, name string, value double"
PARAM_LENGTH = 500
ERROR_LENGTH = 1000
MAX_EXPERIMENTS = 500
MAX_RUNS = 200


def finite_metric(x: Column) -> Column:
    """Infinite and undefined metric values become NULL."""
    x = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    return F.when(F.abs(x) != F.lit(float("inf")), x)


def record_run(
    spark: SparkSession, root: str, experiment_id: str, run_name: str, params: dict, metrics: dict, status: str = "FINISHED",
    started: datetime | None = None,
) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", experiment_id):
        raise ValueError("experiment_id may hold letters, digits, '_' and '-'")
    run_id = uuid.uuid4().hex
    now = datetime.now(timezone.utc)
    runs = spark.createDataFrame([(experiment_id, run_id, run_name, status, started or now, now)], RUNS)
    runs.write.mode("append").parquet(f"{root}/runs")
    rows = [(run_id, str(k), str(v)) for k, v in params.items()]
    spark.createDataFrame(rows, VALUES).write.mode("append").parquet(f"{root}/params")
    values = [(run_id, str(k), None if v is None else float(v)) for k, v in metrics.items()]
    spark.createDataFrame(values, METRICS).write.mode("append").parquet(f"{root}/metrics")
    return run_id


def list_experiments(spark: SparkSession, root: str, limit: int = 100) -> DataFrame:
    if not 1 <= limit <= MAX_EXPERIMENTS:
        raise ValueError(f"limit must be 1..{MAX_EXPERIMENTS}")
    runs = spark.read.parquet(f"{root}/runs")
    return (
        runs.groupBy("experiment_id").agg(F.count("*").alias("runs"), F.min("start_time").alias("created"))
        .orderBy(F.desc("created"), "experiment_id").limit(limit)
    )


def experiment_runs(spark: SparkSession, root: str, experiment_id: str, limit: int = 50) -> DataFrame:
    """Newest runs of one experiment with their metrics and parameters as maps."""
    if not 0 <= limit <= MAX_RUNS:
        raise ValueError(f"limit must be 0..{MAX_RUNS}")
    runs = spark.read.parquet(f"{root}/runs").filter(F.col("experiment_id") == experiment_id)
    newest = runs.orderBy(F.desc("start_time"), "run_id").limit(limit)
    return attach_values(newest, spark.read.parquet(f"{root}/params"), spark.read.parquet(f"{root}/metrics"))


def attach_values(runs: DataFrame, params: DataFrame, metrics: DataFrame) -> DataFrame:
    chosen = runs.select("run_id")
    p = params.join(chosen, "run_id", "left_semi").groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.substring("value", 1, PARAM_LENGTH))))).alias("params")
    )
    m = metrics.join(chosen, "run_id", "left_semi").groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", finite_metric(F.col("value")))))).alias("metrics")
    )
    return runs.join(p, "run_id", "left").join(m, "run_id", "left")


def short_error(error: BaseException) -> str:
    text = " ".join(str(error).split())
    return (text or type(error).__name__)[:ERROR_LENGTH]


def leaderboard(spark: SparkSession, results: list[dict]) -> DataFrame:
    """One row per model: state, metric and error text."""
    rows = [(r["model"], r["state"], r.get("metric"), r.get("error")) for r in results]
    return spark.createDataFrame(rows, "model string, state string, metric double, error string")


def leaderboard_summary(board: DataFrame) -> DataFrame:
    return board.agg(
        F.count("*").alias("expected"), F.count_if(F.col("state") == "succeeded").alias("succeeded"),
        F.count_if(F.col("state") == "failed").alias("failed"),
    ).withColumn("state", F.when(F.col("failed") == 0, "complete").otherwise("partial_failure"))
