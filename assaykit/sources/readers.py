"""Reading sample tables: headers, missing tokens, file catalog, bounded inspection."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.table import c, nan_to_null

MAX_COLUMNS = 256
MAX_NAME = 128
# Texts that count as a missing cell (trimmed, lower case).
MISSING_TOKENS = ("", "na", "n/a", "nan", "null", "none")
SAMPLE_ROWS = 50


class HeaderError(ValueError):
    pass


def clean_header(raw: Sequence[str | None], max_columns: int = MAX_COLUMNS, rename_duplicates: bool = False) -> list[str]:
    """Blank names become ``Unnamed: i``; unusable names are errors; repeats are errors or get ``.1``, ``.2``."""
    if not 0 < len(raw) <= max_columns:
        raise HeaderError(f"a table needs 1 to {max_columns} columns, got {len(raw)}")
    names = [f"Unnamed: {i}" if v in (None, "") else str(v) for i, v in enumerate(raw)]
    for i, name in enumerate(names):
        if name != name.strip() or not name.strip():
            raise HeaderError(f"column {i + 1} has outer white space: {name!r}")
        if len(name) > MAX_NAME or re.search(r"[\x00-\x1f\x7f]", name):
            raise HeaderError(f"column {i + 1} has an unusable name")
    repeats = {n for n in names if names.count(n) > 1}
    if repeats and not rename_duplicates:
        raise HeaderError(f"repeated column names: {sorted(repeats)}")
    taken, out = set(names), []
    for name in names:
        final, suffix = name, 0
        while final in out:
            suffix += 1
            final = f"{name}.{suffix}"
            if final in taken and final not in out:
                final = name
        out.append(final)
    return out


def header_warnings(spark: SparkSession, raw: Sequence[str | None], names: Sequence[str]) -> DataFrame:
    rows = [(i + 1, r or "", n) for i, (r, n) in enumerate(zip(raw, names)) if (r or "") != n]
    return spark.createDataFrame(rows, "position int, original string, used string")


def missing_to_null(x: Column) -> Column:
    return F.when(~F.lower(F.trim(x)).isin(*MISSING_TOKENS), x)


def clean_cells(df: DataFrame) -> DataFrame:
    """NaN and missing tokens become NULL in every column."""
    df = nan_to_null(df)
    return df.select(*[
        missing_to_null(c(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else c(f.name)
        for f in df.schema.fields
    ])


def read_samples(
    spark: SparkSession, path: str, format: str = "csv", schema: str | T.StructType | None = None,
    rename_duplicates: bool = False,
) -> DataFrame:
    """One sample table (csv, parquet, json or orc), headers and missing cells normalised.

    Give a schema for large CSV files: without one the file is read twice to infer types.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if format != "csv":
        return clean_cells(reader.format(format).load(path))
    reader = reader.option("header", "true").option("nullValue", "").option("nanValue", "NaN")
    if schema is not None:
        return clean_cells(reader.csv(path))
    text = spark.read.option("header", "false").option("inferSchema", "false").csv(path)
    raw = text.first()
    if raw is None:
        raise HeaderError("the file is empty")
    names = clean_header(list(raw), rename_duplicates=rename_duplicates)
    typed = clean_cells(reader.option("enforceSchema", "true").option("inferSchema", "true").csv(path).toDF(*names))
    return tighten_types(typed)


def tighten_types(df: DataFrame) -> DataFrame:
    """Text columns whose every known cell is a number become double (missing tokens hid their type)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    row = df.agg(*[
        F.count_if(c(n).isNotNull() & c(n).try_cast("double").isNull()).alias(f"b{i}") for i, n in enumerate(text)
    ], *[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(text)]).first()
    numeric = {n for i, n in enumerate(text) if row[f"b{i}"] == 0 and row[f"n{i}"] > 0}
    return df.select(*[c(n).cast("double").alias(n) if n in numeric else c(n) for n in df.columns])


def dataset_catalog(spark: SparkSession, folder: str, roles: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per file: path below the folder, name, format, size, sha-256, row count, column count, task and role.

    Files are hashed and their CSV records counted where they lie, by a CSV parser: quoted commas and line breaks are
    part of their cell, blank lines are no record, the first record is the header; a file of no bytes has none and is not listed. ``roles`` are keyed by path below
    the folder or by file name. Files must fit a Spark binary value (2 GiB); larger ones should be split on export,
    as every reader here takes folders.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,parquet}").load(folder)
    kind = F.lower(F.element_at(F.split("path", "\\."), -1))

    @F.pandas_udf("row_count long, column_count int")
    def shape(contents: pd.Series, formats: pd.Series) -> pd.DataFrame:
        out = []
        for content, form in zip(contents, formats):
            if form != "csv":
                out.append((None, None))
                continue
            text = bytes(content).decode("utf-8-sig", "replace")
            records = (r for r in csv.reader(io.StringIO(text, newline="")) if r)
            head = next(records, None)
            out.append((sum(1 for _ in records), len(head)) if head is not None else (0, 0))
        return pd.DataFrame(out, columns=["row_count", "column_count"]).astype({"row_count": "Int64", "column_count": "Int32"})

    base = folder.rstrip("/").rsplit("/", 1)[-1]
    out = files.select(
        F.substring_index("path", f"/{base}/", -1).alias("relative_path"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"), kind.alias("format"), F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"), shape("content", kind).alias("s"),
    ).select("relative_path", "file_name", "format", "size_bytes", "sha256", "s.*")
    task, role = F.lit(None).cast("string"), F.lit("unspecified")
    for name, (of_task, of_role) in (roles or {}).items():
        hit = (F.col("relative_path") == name) | (F.col("file_name") == name)
        task, role = F.when(hit, F.lit(of_task)).otherwise(task), F.when(hit, F.lit(of_role)).otherwise(role)
    return out.withColumn("task", task).withColumn("role", role)


def inferred_type(x: Column) -> Column:
    """integer / number / boolean / string of one cell, NULL for an empty one."""
    text = F.trim(x.cast("string"))
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(F.lower(text).isin("true", "false"), "boolean")
        .when(text.rlike(r"^[+-]?\d+$"), "integer")
        .when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "number")
        .otherwise("string")
    )


def inspect_columns(df: DataFrame, order_by: Sequence[str], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Type seen in the first rows of each column and how many of those cells are filled."""
    sample = df.orderBy(*[c(n) for n in order_by]).limit(sample_rows)
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("feature"), inferred_type(c(n)).alias("t"))
        for i, n in enumerate(df.columns)
    ])
    seen = sample.select(F.explode(cells).alias("s")).select("s.*").groupBy("position", "feature").agg(
        F.array_sort(F.collect_set("t")).alias("types"), F.count("t").alias("sampled_non_null")
    )
    kind = (
        F.when(F.size("types") == 0, "empty")
        .when(F.col("types") == F.array(F.lit("integer"), F.lit("number")), "number")
        .when(F.size("types") == 1, F.col("types")[0])
        .otherwise("mixed")
    )
    return seen.select("position", "feature", kind.alias("inferred_type"), "sampled_non_null")


def inspect_table(df: DataFrame, order_by: Sequence[str], first_rows: int = 5) -> dict:
    """Row and column counts, column summaries and the first rows of a table."""
    return {
        "row_count": df.count(),
        "column_count": len(df.columns),
        "columns": inspect_columns(df, order_by),
        "rows": df.orderBy(*[c(n) for n in order_by]).limit(first_rows),
    }
