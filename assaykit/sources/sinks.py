"""Writing result tables and models. All writes are plain Spark writes to shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.table import c


def save_with_identifier(
    df: DataFrame, path: str, row_id: str, columns: Sequence[str] | None = None, format: str = "parquet", mode: str = "errorifexists"
) -> str:
    """The row identifier first, then the chosen columns."""
    names = [n for n in (columns or df.columns) if n != row_id]
    return save_table(df.select(c(row_id), *[c(n) for n in names]), path, format, mode)


def save_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> str:
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", "true")
    writer.save(path)
    return path


def save_model(model: PipelineModel, path: str) -> str:
    model.write().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.col("name"))
