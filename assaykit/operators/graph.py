"""Connected components of an edge table by alternating star contraction (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.table import cut_lineage, written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each component as its name.

    Each round keeps the number of edges or shrinks it. The smallest neighbour is a partial minimum and is written to the
    shared folder before it is joined back, so both sides of that join are plain exchanges and a hub's partition can be split
    at run time. Rounds end when nothing moves.
    """
    current = edges.select("a", "b").filter("a <> b").distinct()
    current = written(current)
    before = None
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        low = written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        large = written(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct())
        # small star: a node and its smaller neighbours move to the smallest of them
        low = written(large.groupBy("a").agg(F.min("b").alias("low")))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b"))
        ).filter("a <> b").distinct()
        current = written(small)
        mark = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    found = current.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = found.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return found.unionByName(roots)


def forest_roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as ``parents(node, parent)``; a root has no row or is its own parent.

    Pointers double in every join, so a chain of n nodes takes about log2(n) of them; two are made before each checkpoint.
    """
    current = written(parents.select("node", F.col("parent").alias("root")))
    for _ in range(MAX_ROUNDS):
        further = current.withColumn("moved", F.lit(False))
        for _ in range(2):
            up = current.select(F.col("node").alias("_at"), F.col("root").alias("_up"))
            further = further.join(up, F.col("root") == F.col("_at"), "left").select(
                "node", F.coalesce("_up", "root").alias("root"), (F.col("moved") | F.coalesce(F.col("_up") != F.col("root"), F.lit(False))).alias("moved")
            )
        further = written(further)
        current = further.select("node", "root")
        if further.filter("moved").isEmpty():
            return current
    raise RuntimeError("roots did not settle")


def number_in_order(heads: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """0-based numbers of distinct keys in sorted order: sorted ranges, counted, then numbered inside. ``keep`` names further columns."""
    ranged = cut_lineage(heads.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count().orderBy("_part").collect()
    start, offsets = 0, []
    for r in sizes:
        offsets.append((r["_part"], start))
        start += r["count"]
    table = F.broadcast(heads.sparkSession.createDataFrame(offsets, "_part int, _start long"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(key))
    return ranged.withColumn("_k", inside).join(table, "_part").select(key, *keep, (F.col("_start") + F.col("_k") - 1).alias("_no"))
