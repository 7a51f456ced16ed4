"""Column roles, row-keyed randomness and the shared-folder rules every operator relies on."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_HEX_DIGITS = 13
HASH_SCALE = float(2**52)


@dataclass(frozen=True)
class TableSpec:
    """Names the columns of one sample table by role; the data stays in a single DataFrame."""

    row_id: str = "row_id"
    features: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    lat: str | None = None
    lon: str | None = None
    split: str = "split"

    def with_features(self, features: Sequence[str]) -> TableSpec:
        return replace(self, features=tuple(features))


def q(name: str) -> str:
    """Back-quote a column name: sample tables have names such as ``SIO2(WT%)``."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


def row_key(*cols: str | Column) -> Column:
    """One string key out of several key columns."""
    return F.concat_ws("-", *[(c(x) if isinstance(x, str) else x).cast("string") for x in cols])


def hash_uniform(seed: int | str, *keys: str | Column) -> Column:
    """Uniform [0, 1) draw that depends only on the seed and the row key, never on partitioning."""
    text = F.concat_ws("-", F.lit(str(seed)), *[(c(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HASH_HEX_DIGITS), 16, 10).cast("double") / F.lit(HASH_SCALE)


def hash_uniform_sql(seed: int | str, *keys: str) -> str:
    """The same draw as DuckDB text, for the oracle."""
    text = "concat_ws('-', '" + str(seed) + "', " + ", ".join(f"cast({k} AS VARCHAR)" for k in keys) + ")"
    return f"(('0x' || substr(md5({text}), 1, {HASH_HEX_DIGITS}))::UBIGINT / {HASH_SCALE:.1f})"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark separates NaN from NULL and would average NaN in; sample tables have one kind of missing."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(c(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(c(f.name))
    return df.select(*cols)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is made only on one machine that names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    made = tempfile.mkdtemp(prefix="assaykit-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``scratch_path`` named, once nothing reads it any more."""
    if not path.startswith(shared_folder(spark) + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files stay until the driver collects the tables that read them; loops that shuffle much ask for that."""
    gc.collect()
    spark._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative jobs restart from shared storage when executors are lost."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder, for loops that join what they cut with itself.

    A checkpoint keeps the size its plan was estimated to have, and joins multiply such estimates, so after some rounds planning
    deals with numbers of thousands of digits. A written table has the size of its files.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def features_array(features: Sequence[str]) -> Column:
    return F.array(*[c(f).cast("double") for f in features])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def long_form(row: DataFrame, names: Sequence[str], parts: dict[str, str], key: str = "feature") -> DataFrame:
    """Turn a one-row wide aggregate into one row per feature.

    ``parts`` maps an output column to the format of the wide column, e.g. ``{"mean": "mean_{}"}``
    where ``{}`` is the position of the feature.
    """
    structs = [
        F.struct(F.lit(n).alias(key), *[F.col(fmt.format(i)).alias(out) for out, fmt in parts.items()])
        for i, n in enumerate(names)
    ]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
