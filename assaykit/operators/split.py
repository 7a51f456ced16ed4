"""Train/test splits, folds and class balancing keyed by row, independent of partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.table import c, cut_lineage, hash_uniform

CLASS_LIMIT = 10_000
# hash cells in which rows of a class are counted before any is ranked
CELLS = 1 << 20


def random_split(df: DataFrame, row_id: str, test_size: float = 0.2, seed: int = 42, exact: bool = False) -> DataFrame:
    """Add ``split`` = train/test. ``exact=True`` puts exactly ceil(n * test_size) rows into test."""
    u = hash_uniform(seed, row_id)
    if not exact:
        return df.withColumn("split", F.when(u < test_size, "test").otherwise("train"))
    if test_size <= 0:
        return df.withColumn("split", F.lit("train"))
    one = F.lit(0)
    total = df.count()
    test = _first_rows(df.withColumn("_class", one), row_id, "_class", u, {0: [math.ceil(total * test_size)]})
    return test.withColumn("split", F.when(F.col("_slice") == 0, "test").otherwise("train")).select(*df.columns, "split")


def class_counts(df: DataFrame, target: str) -> dict:
    rows = df.groupBy(c(target).alias("k")).count().limit(CLASS_LIMIT + 1).collect()
    if len(rows) > CLASS_LIMIT:
        raise ValueError(f"{target} has more than {CLASS_LIMIT} classes")
    return {r["k"]: r["count"] for r in rows}


def _first_rows(df: DataFrame, row_id: str, target: str, u: Column, sizes: dict) -> DataFrame:
    """``df`` with ``_slice``: how many of its class's ascending ``sizes`` a row's place in hash order reaches or passes.

    Places are taken in the order (hash, row id), so equal hashes change no size. Rows are first counted by class and
    hash cell; only in the cells where a slice ends are rows ranked. That is one grouped job for any number of classes,
    and what is joined back is one row for each class and slice.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[target]
    wanted = [(k, j, int(n)) for k, at in sizes.items() for j, n in enumerate(at)]
    table = spark.createDataFrame(wanted, f"_k {kind}, _j int, _n long")
    keyed = df.select(c(target).alias("_k"), u.alias("_u"), c(row_id).cast("string").alias("_id")).withColumn("_cell", F.floor(F.col("_u") * CELLS))
    counts = keyed.groupBy("_k", "_cell").agg(F.count("*").alias("_m")).withColumn("_block", F.floor(F.col("_cell") / 1024))
    blocks = counts.groupBy("_k", "_block").agg(F.sum("_m").alias("_b"))
    before = W.partitionBy("_k").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("_k", "_block", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_k", "_block").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_in", F.coalesce(F.sum("_m").over(inside), F.lit(0))).alias("a")
    at = counts.join(blocks.alias("b"), F.col("a._k").eqNullSafe(F.col("b._k")) & (F.col("a._block") == F.col("b._block")))
    at = at.select(F.col("a._k").alias("_k"), "_cell", "_m", (F.col("_in") + F.col("_base")).alias("_before"))
    ends = F.broadcast(table.filter("_n > 0")).alias("t").join(at.alias("a"), F.col("a._k").eqNullSafe(F.col("t._k")) & F.expr("_n > _before AND _n <= _before + _m"))
    ends = cut_lineage(ends.select(F.col("t._k").alias("_k"), "_j", "_cell", (F.col("_n") - F.col("_before")).alias("_place")))
    cells = ends.select("_k", "_cell").distinct()
    near = keyed.alias("x").join(F.broadcast(cells).alias("e"), F.col("x._k").eqNullSafe(F.col("e._k")) & (F.col("x._cell") == F.col("e._cell")), "left_semi")
    ranked = near.withColumn("_rank", F.row_number().over(W.partitionBy("_k", "_cell").orderBy("_u", "_id")))
    edges = ranked.alias("r").join(F.broadcast(ends).alias("e"), F.col("r._k").eqNullSafe(F.col("e._k")) & F.expr("r._cell = e._cell AND _rank = _place"))
    edges = edges.groupBy(F.col("r._k").alias("_k")).agg(F.array_sort(F.collect_list(F.struct(F.col("_u").alias("u"), F.col("_id").alias("id")))).alias("_edges"))
    none = table.groupBy("_k").agg(F.count_if(F.col("_n") <= 0).cast("int").alias("_none")).withColumnRenamed("_k", "_key")
    found = none.alias("n").join(edges.alias("f"), F.col("n._key").eqNullSafe(F.col("f._k")), "left").select("_key", "_none", "_edges")
    found = F.broadcast(cut_lineage(found))
    rows = df.withColumn("_u", u).join(found, c(target).eqNullSafe(F.col("_key")), "left")
    passed = F.size(F.filter("_edges", lambda e: (e["u"] < F.col("_u")) | ((e["u"] == F.col("_u")) & (e["id"] < c(row_id).cast("string")))))
    passed = F.coalesce("_none", F.lit(0)) + F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(passed)
    return rows.withColumn("_slice", passed).drop("_u", "_key", "_none", "_edges")


def _by_class(target: str, values: dict, default):
    """The value of a row's class: one look-up in a map literal, whatever the number of classes."""
    out = F.lit(default)
    known = {k: v for k, v in values.items() if k is not None}
    if known:
        table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        out = F.coalesce(F.try_element_at(table, c(target)), F.lit(default))
    if None in values:
        out = F.when(c(target).isNull(), F.lit(values[None])).otherwise(out)
    return out


def stratified_split(df: DataFrame, row_id: str, target: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Every class gives ceil(n_class * test_size) rows to test; the share grows when a class would be absent."""
    counts = class_counts(df, target)
    small = [k for k, n in counts.items() if n < 2]
    if small:
        raise ValueError(f"classes with fewer than two rows: {small}")
    total = sum(counts.values())
    size = max(test_size, len(counts) / total)
    wanted = {k: [min(n - 1, max(1, math.ceil(n * size)))] for k, n in counts.items()}
    rows = _first_rows(df, row_id, target, hash_uniform(seed, row_id), wanted)
    return rows.withColumn("split", F.when(F.col("_slice") == 0, "test").otherwise("train")).drop("_slice")


def hash_folds(df: DataFrame, row_id: str, k: int = 10, seed: int = 42) -> DataFrame:
    """Fold number 0..k-1 from the row hash."""
    return df.withColumn("fold", F.floor(hash_uniform(seed, row_id) * k).cast("int"))


def stratified_folds(df: DataFrame, row_id: str, target: str, k: int = 10, seed: int = 42) -> tuple[DataFrame, int]:
    """min(k, smallest class) folds; inside a class the folds are equal slices of the hash order."""
    counts = class_counts(df, target)
    smallest = min(counts.values())
    if smallest < 2:
        raise ValueError("cross-validation needs two rows in every class")
    k = min(k, smallest)
    sizes = {v: [math.ceil(n * f / k) for f in range(1, k)] for v, n in counts.items()}
    rows = _first_rows(df, row_id, target, hash_uniform(seed, row_id), sizes)
    return rows.withColumn("fold", F.col("_slice").cast("int")).drop("_slice"), k


def over_sample(df: DataFrame, row_id: str, target: str, seed: int = 42) -> DataFrame:
    """Repeat rows of smaller classes until every class has the size of the largest; ``copy`` numbers them."""
    counts = class_counts(df, target)
    top = max(counts.values())
    whole = {k: top // n for k, n in counts.items()}
    rows = _first_rows(df, row_id, target, hash_uniform(seed, row_id), {k: [top - whole[k] * n] for k, n in counts.items()})
    copies = _by_class(target, whole, 1) + F.when(F.col("_slice") == 0, 1).otherwise(0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("_slice")


def under_sample(df: DataFrame, row_id: str, target: str, seed: int = 42) -> DataFrame:
    """A hash-chosen subset of every class with the size of the smallest class."""
    counts = class_counts(df, target)
    low = min(counts.values())
    rows = _first_rows(df, row_id, target, hash_uniform(seed, row_id), {k: [low] for k in counts})
    return rows.filter("_slice = 0").drop("_slice")


def over_then_under_sample(df: DataFrame, row_id: str, target: str, seed: int = 42) -> DataFrame:
    """After over-sampling all classes are equal, so the second step keeps every row."""
    return over_sample(df, row_id, target, seed)
