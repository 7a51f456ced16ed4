"""Packing: length buckets with the least padding, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaykit.table import cut_lineage, hash_uniform

MAX_WORDS = 2048
BUCKETS = 16
BATCH_TOKENS = 32768
BETWEEN = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Tokens of a text: runs of non-white-space; a null text has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least total padding.

    ``lengths`` ascend. A bucket pads each of its rows to its largest length, so the best cuts of the first j
    lengths into b buckets extend the best cuts of some shorter prefix into b - 1; ties take the shorter prefix.
    """
    if not lengths:
        return []
    size, n = np.asarray(lengths, np.float64), len(lengths)
    rows = np.concatenate([[0.0], np.cumsum(np.asarray(counts, np.float64))])
    tokens = np.concatenate([[0.0], np.cumsum(size * np.asarray(counts, np.float64))])
    best, cut = np.full(n + 1, np.inf), []
    best[0] = 0.0
    for _ in range(min(buckets, n)):
        now, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            back[j] = int(np.argmin(cost))
            now[j] = cost[back[j]]
        best = now
        cut.append(back)
    out, j = [], n
    for back in reversed(cut):
        out.append(int(lengths[j - 1]))
        j = int(back[j])
    return out[::-1]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = MAX_WORDS) -> DataFrame:
    """(key, piece, start, length): each document in runs of ``limit`` tokens and a rest.

    Null, empty and blank texts have no tokens and give no piece; repeated rows give repeated pieces.
    """
    n = F.col("n")
    counted = docs.select(F.col(key), word_count(F.col(text)).alias("n")).filter("n > 0")
    parts = counted.select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / limit))).alias("piece"))
    return parts.select(key, "piece", (F.col("piece") * limit).alias("start"), F.least(F.lit(limit).cast("long"), n - F.col("piece") * limit).alias("length"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = MAX_WORDS, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per piece: ``key, piece, start, length, bucket`` (padded length), ``batch, slot``.

    The histogram of piece lengths has at most ``limit`` rows, so the dynamic programme over it is exact and small
    at any input size. A batch holds ``batch_tokens // bucket`` pieces (at least one), so its padded size stays within
    the budget, and only the last batch of a bucket can be short. Pieces are ranked in a bucket by hash (of key and piece):
    counts of hash ranges are summed first and ranks are taken inside a range, so no bucket is sorted in one task.
    An empty table gives an empty result.
    """
    if batch_tokens < limit:
        raise ValueError("a batch must hold at least one piece of the largest length")
    rows = pieces(docs, key, text, limit).withColumn("hash", hash_uniform("pack", key, "piece"))
    rows = cut_lineage(rows.select(F.col(key).alias("doc"), "piece", "start", "length", "hash"))
    table = rows.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()  # at most ``limit`` rows
    bounds = boundaries([r["length"] for r in table], [r["n"] for r in table], buckets)
    if not bounds:
        bounds = [limit]
    total = sum(r["n"] for r in table)
    shards = max(8, total // 20_000)
    bucket = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("length") <= b, F.lit(b)).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket.cast("long")).withColumn("shard", F.floor(F.col("hash") * shards))
    counts = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    # running totals over (bucket, block of shards) and then inside a block keep each window small
    counts = cut_lineage(counts.withColumn("block", F.floor(F.col("shard") / 1000)))
    per_block = counts.groupBy("bucket", "block").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select("bucket", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket", "block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("head", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(per_block, ["bucket", "block"])
    offsets = cut_lineage(offsets.select("bucket", "shard", (F.col("head") + F.col("base")).alias("offset")))
    order = Window.partitionBy("bucket", "shard").orderBy("hash", "doc", "piece", "length")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["bucket", "shard"])
    place, room = F.col("rank") + F.col("offset"), F.floor(F.lit(batch_tokens) / F.col("bucket"))
    return ranked.select(
        F.col("doc").alias(key), "piece", "start", "length", "bucket", F.floor(place / room).alias("batch"), F.pmod(place, room).alias("slot")
    )
