"""Score rows as they arrive: a fitted preparation and model applied to a streaming table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from assaykit.table import nan_to_null


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_trigger)
    return nan_to_null(reader.load(path))


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, format: str = "parquet"):
    """Start a query that appends scored rows; file sinks with a checkpoint write each row once."""
    return (
        score(stream).writeStream.format(format).outputMode("append").option("path", output)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
