"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import decontaminate, line_dedup, packing, quality, simhash
from assaykit.table import read_table, remove_scratch, scratch_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts."""
    return quality.accept(docs, read_table(spark, sf_dir, "labels"))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with lines that came earlier taken out; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs, counts=False)
    columns = [F.length("text").cast(kind).alias("n_chars") if name == "n_chars" else F.col(name) for name, kind in docs.dtypes]
    return out.select(*columns)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.keep_one(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_filter),
    ("near_dedup", near_duplicate_filter),
    ("decontamination", benchmark_filter),
    ("packing", packing_plan),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage keeps is written to the shared folder and read again.

    A stage's folder is removed once the next one is written, so at most two copies of the corpus are kept.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_scratch(spark, before)
        before = path
    return docs
