"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified bit distance, classes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.links import components
from assaykit.table import cut_lineage

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# text is hashed in pieces of about this many bytes, so a very long text needs bounded memory
PIECE_BYTES = 1 << 20
# blocks holding more fingerprints than this are linked through shared one-bit neighbours instead of pairs
PAIR_LIMIT = 32


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded piece at a time; a word is never cut."""
    start, end = 0, len(data)
    while start < end:
        stop = start + PIECE_BYTES
        while stop < end and not data[stop : stop + 1].isspace():
            stop += 1
        yield data[start:stop].split()
        start = stop


def simhash(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles, repeats included: a bit is 1 if set in over half the hashes.

    Words are runs of non-white-space after A-Z are lower-cased. Fewer words than ``size``: the whole sequence
    is one shingle. No words (null, empty, blank): zero.
    """
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        if len(words) >= size:
            grams = map(b" ".join, zip(*(words[i:] for i in range(size))))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail = words[-(size - 1) :] if size > 1 else []
    if total == 0:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text, size: int = SHINGLE_WORDS):
    """The fingerprint as a signed long column."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, size) for t in texts], np.uint64).view(np.int64))

    return hashed(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links that join exactly the classes of ``prints(fp)`` pairs within ``max_bits`` bits.

    The 64 bits are cut into ``max_bits + 3`` blocks. A close pair agrees on at least three of them, so every
    choice of three blocks is a join key and no close pair is missed. A pair's distance is verified by the bit
    count of its difference. In a block of many fingerprints pairs are not listed: fingerprints within two bits
    share a neighbour at one bit, at most 65 share one, so grouping by neighbour links the block in linear work.
    """
    n = max_bits + 3
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(n)]
    masks = [sum(chosen) for chosen in combinations(blocks, 3)]
    rows = prints.select("fp").distinct().select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("block"),
    ).select("fp", "block.part", "block.key")
    shared = rows.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = cut_lineage(rows.join(shared, ["part", "key"]))
    few = rows.filter(F.col("n") <= PAIR_LIMIT) if max_bits == 2 else rows
    other = few.select("part", "key", F.col("fp").alias("b"))
    pairs = few.select("part", "key", F.col("fp").alias("a")).join(other, ["part", "key"]).filter("a < b")
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    if max_bits != 2:
        return pairs.distinct()
    flips = [0] + [1 << i for i in range(64)]
    near = rows.filter(F.col("n") > PAIR_LIMIT).select("fp").distinct().select(
        "fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(x))) for x in flips])).alias("middle")
    )
    meets = near.groupBy("middle").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    stars = meets.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def _classes(docs: DataFrame, key: str, text: str, size: int, max_bits: int) -> DataFrame:
    """(doc, text_hash, fp, root) of every row; ``root`` is the smallest (unnamed, doc, text_hash) of its class, null keys last."""
    prints = cut_lineage(
        docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), fingerprint_column(F.col(text), size).alias("fp"))
    )
    row = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "text_hash")
    first = cut_lineage(prints.groupBy("fp").agg(F.min(row).alias("first")))
    named = cut_lineage(
        first.join(components(fingerprint_links(first, max_bits)).withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    )
    root = cut_lineage(named.groupBy("component").agg(F.min("first").alias("root")))
    of = cut_lineage(named.join(root, "component").select("fp", "root"))
    return prints.join(of, "fp").select("doc", "text_hash", "fp", "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``fp`` (signed long) and ``component_id``.

    Rows are linked when their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the smallest
    key reachable. Copies share a fingerprint and are one node. Null and empty texts have fingerprint zero and
    are linked like any other; a null key never names a component unless all keys of it are null. An empty table
    gives an empty result; other columns are ignored.
    """
    classes = _classes(docs, key, text, size, max_bits)
    return classes.select(F.col("doc").alias(key), "fp", F.col("root.doc").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with exactly one row of each class: the one with the smallest (key, hash of its text), null keys last.

    Equal keys are told apart by their text, so each class keeps a row even where one key names several classes. Rows
    equal in both count once.
    """
    classes = _classes(docs, key, text, size, max_bits)
    smallest = F.col("doc").eqNullSafe(F.col("root.doc")) & (F.col("text_hash") == F.col("root.text_hash"))
    roots = classes.filter(smallest).groupBy(F.col("doc"), F.col("text_hash").alias("hash")).agg(F.count("*").alias("copies"))
    roots = cut_lineage(roots)
    # the columns go by their places, so none can clash with a name used here
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key_, text_ = (f"c{names.index(x)}" for x in (key, text))

    def among(some: DataFrame) -> DataFrame:
        return rows.join(some, F.col(key_).eqNullSafe(F.col("doc")) & (F.xxhash64(text_) == F.col("hash")), "left_semi")

    again = among(roots.filter("copies > 1")).withColumn("hash", F.xxhash64(text_)).dropDuplicates([key_, "hash"]).drop("hash")
    return among(roots.filter("copies = 1")).unionByName(again).toDF(*names)
