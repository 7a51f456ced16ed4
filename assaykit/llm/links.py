"""Connected components of a link table whose nodes are long keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.table import cut_lineage

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; the smallest node names its component.

    Alternating stars: every larger neighbour of a node moves to the smallest one, then a node and its smaller
    neighbours do. The smallest neighbour is a partial minimum and is written to the shared folder before it is
    joined back, so both sides of that join are plain exchanges and a hub's partition can be split at run time.
    An empty link table gives an empty result; loops and repeated links change nothing.
    """
    current = cut_lineage(links.select("a", "b").filter("a <> b").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut_lineage(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        large = cut_lineage(
            both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        )
        low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("low")))
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()
        )
        current = cut_lineage(small)
        mark = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    found = current.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
