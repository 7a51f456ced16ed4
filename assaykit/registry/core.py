"""Registered queries: name -> Spark callable and, where SQL can say it, the same result as SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.table import c, hash_uniform, hash_uniform_sql, read_table, row_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def rounded(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Doubles rounded and without negative zero, so both engines print the same value."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            d = digits.get(name, 6) if isinstance(digits, dict) else digits
            out.append((F.round(c(name).cast("double"), d) + F.lit(0.0)).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(c(name).cast("bigint").alias(name))
        else:
            out.append(c(name))
    return df.select(*out)


def rsql(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


# lineitem as a sample table: zero discount and zero tax stand for "not measured"
SAMPLE_FEATURES = ("quantity", "price", "discount", "tax")
SAMPLES_SQL = """samples AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round(l_extendedprice * 100) AS BIGINT), cast(l_quantity AS BIGINT)) AS row_id, l_quantity AS quantity,
         l_extendedprice AS price, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax,
         l_discount AS full_discount, l_tax AS full_tax, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    t = read_table(spark, sf, "lineitem")
    return t.select(
        row_key(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.col("l_quantity").cast("bigint"),
        ).alias("row_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.expr("nullif(l_discount, 0)").alias("discount"), F.expr("nullif(l_tax, 0)").alias("tax"),
        F.col("l_discount").alias("full_discount"), F.col("l_tax").alias("full_tax"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )


# documents with labels: a binary task
BINARY_FEATURES = ("n_chars", "n_words", "n_lines")
BINARY_SQL = """binary_task AS (
  SELECT d.doc_id, cast(d.n_chars AS DOUBLE) AS n_chars,
         cast(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS DOUBLE) AS n_words,
         cast(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS DOUBLE) AS n_lines,
         cast(l.quality AS BIGINT) AS quality
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def binary_task(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    text = F.col("text")
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("double").alias("n_words"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("double").alias("n_lines"),
        F.col("quality").cast("long").alias("quality"),
    )


def vectors(spark: SparkSession, sf: str, dims: int) -> DataFrame:
    """Embeddings as a sample table with the first ``dims`` coordinates as features."""
    t = read_table(spark, sf, "embeddings")
    return t.select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(dims)],
        F.col("label").cast("long").alias("label"),
    )


def vectors_sql(dims: int) -> str:
    cols = ", ".join(f"cast(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(dims))
    return f"vectors AS (SELECT vec_id, {cols}, cast(label AS BIGINT) AS label FROM embeddings)"


def dims(n: int) -> list[str]:
    return [f"x{i}" for i in range(n)]


# customers as located, dated samples
GEO_SQL = f"""geo AS (
  SELECT c_custkey AS row_id, 180 * {hash_uniform_sql('lat', 'c_custkey')} - 90 AS latitude,
         360 * {hash_uniform_sql('lon', 'c_custkey')} - 180 AS longitude,
         400 * {hash_uniform_sql('age', 'c_custkey')} AS age,
         400 * {hash_uniform_sql('age', 'c_custkey')} + 50 * {hash_uniform_sql('err', 'c_custkey')} AS age_max,
         {hash_uniform_sql('p', 'c_custkey')} AS probability
  FROM customer)"""


def geo(spark: SparkSession, sf: str) -> DataFrame:
    t = read_table(spark, sf, "customer")
    age = 400 * hash_uniform("age", "c_custkey")
    return t.select(
        F.col("c_custkey").alias("row_id"), (180 * hash_uniform("lat", "c_custkey") - 90).alias("latitude"),
        (360 * hash_uniform("lon", "c_custkey") - 180).alias("longitude"), age.alias("age"),
        (age + 50 * hash_uniform("err", "c_custkey")).alias("age_max"), hash_uniform("p", "c_custkey").alias("probability"),
    )


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)
