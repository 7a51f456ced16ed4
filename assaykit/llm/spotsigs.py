"""SpotSigs fingerprints: chains of content words after common words, compared by pruned Jaccard."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.links import components
from assaykit.table import cut_lineage

# Common words of English, German, French and Spanish that anchor signatures.
ANCHORS = frozenset(
    """a an the and or of to in is are was were be been it this that for with on at by from as he she they you i we not have has had
    der die das und ist von zu den mit im dem des ein eine für auf auch nicht sich es als an werden wird
    le la les et un une des du est en que qui dans pour par sur au avec ne pas plus ce il elle
    el los las y de se no lo con su una por es al como más pero sus""".split()
)
CHAIN_WORDS = 3
# sets whose Jaccard likeness is at least this are linked
THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")


def signatures(text: str | None, chain: int = CHAIN_WORDS) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the anchored chains of a text.

    A chain is an anchor and the next ``chain`` content words (no anchors) after it, fewer at the end of the text. A text
    whose words hold no anchor is one chain of all its words; without words the text itself is hashed; an empty
    text has no signature.
    """
    text = text or ""
    if not text:
        return np.empty(0, np.uint32)
    words = WORD.findall(text.lower())
    anchor = ANCHORS
    content = [w for w in words if w not in anchor]
    out, ahead = [], 0
    if len(content) < len(words):
        for w in words:
            if w in anchor:
                out.append(f"{w}:{':'.join(content[ahead : ahead + chain])}")
            else:
                ahead += 1
    else:
        out.append(" ".join(words) if words else text)
    seed = xxhash.xxh32_intdigest
    return np.unique(np.fromiter(map(seed, {x.encode("utf-8", "surrogatepass") for x in out}), np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two signature sets; 1 for two empty ones. Zero as soon as the set lengths alone rule ``least`` out."""
    n, m = len(a), len(b)
    if n == 0 and m == 0:
        return 1.0
    if min(n, m) == 0 or min(n, m) < least * max(n, m):
        return 0.0
    if a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (n + m - both)


def fingerprint(signature: np.ndarray) -> str:
    """Set length and all signatures as hex digits, so a fingerprint compares without the text."""
    return f"{len(signature):x}:" + signature.astype(">u4").tobytes().hex()


def parse(fingerprint_: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint_.partition(":")[2]), ">u4").astype(np.uint32)


def length_partitions(limit: int, threshold: float) -> list[int]:
    """Upper bounds of set-length partitions: a set's matches lie in its own partition or the next one."""
    out, top = [], 1
    while top < limit:
        out.append(top)
        top = max(top + 1, int(top / threshold))
    return [*out, limit]


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) for every pair ``a < b`` of ``sets(id, sigs)`` with distinct non-empty ``sigs`` whose Jaccard likeness is at least ``threshold``.

    A set goes to the partition of its length and to the next one, so a pair meets in the partition of its longer set. Sets are
    joined on their rarest signatures: of n ordered by frequency, like sets share one of the first n - ceil(threshold n) + 1.
    Candidates whose lengths or positions rule the threshold out are dropped before the whole sets are compared.
    """
    spark = sets.sparkSession
    sets = cut_lineage(sets.withColumn("n", F.size("sigs")))
    longest = sets.agg(F.max("n").alias("n")).first()["n"]
    if longest is None:
        return spark.createDataFrame([], "a long, b long")
    bounds = length_partitions(longest + 1, threshold)
    each = sets.select("id", "n", F.explode("sigs").alias("sig"))
    common = cut_lineage(each.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1"))
    ranked = each.join(common, "sig").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("rare"))
    # signatures of one set only come first in the order of frequency, and meet nothing
    alone = F.col("n") - F.size("rare")
    first = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    prefix = ranked.select("id", "n", alone.alias("alone"), F.slice("rare", F.lit(1), F.greatest(first - alone, F.lit(0))).alias("rare"))
    prefix = prefix.select("id", "n", "alone", F.posexplode("rare").alias("at", "r")).select(
        "id", "n", F.col("r.sig").alias("sig"), (F.col("alone") + F.col("at")).alias("at"), _rank(bounds, F.col("n")).alias("part")
    )
    prefix = cut_lineage(prefix)
    own = prefix.select("sig", "part", F.col("id").alias("i"), F.col("n").alias("ni"), F.col("at").alias("ai"))
    routed = prefix.select("sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("id").alias("j"), F.col("n").alias("nj"), F.col("at").alias("aj"))
    met = own.join(routed, ["sig", "part"]).filter((F.col("nj") < F.col("ni")) | ((F.col("nj") == F.col("ni")) & (F.col("j") < F.col("i"))))
    least = F.lit(threshold / (1 + threshold)) * (F.col("ni") + F.col("nj")) - 1e-9
    left = F.lit(1) + F.least(F.col("ni") - F.col("ai") - 1, F.col("nj") - F.col("aj") - 1)
    # a pair's first shared signature gives its bound; later ones can only be lower
    pairs = met.filter((F.col("nj") >= F.col("ni") * F.lit(threshold) - 1e-9) & (left >= least)).select("i", "j").distinct()
    x = sets.select(F.col("id").alias("i"), F.col("sigs").alias("x"))
    y = sets.select(F.col("id").alias("j"), F.col("sigs").alias("y"))

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(np.asarray(p), np.asarray(q), threshold) for p, q in zip(a, b)], dtype="float64")

    found = pairs.join(x, "i").join(y, "j").withColumn("like", likeness("x", "y")).filter(F.col("like") >= threshold)
    return found.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``class_id`` and ``n_links``, from a search over all documents.

    Rows whose signature sets have a Jaccard likeness of at least ``threshold`` are linked; ``class_id`` is the smallest key
    reachable, a null key names a class only if all its keys are null, and ``n_links`` counts the other rows a row is linked with.
    Rows with equal sets are one node; empty texts are alike.
    """

    @F.pandas_udf("array<long>")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series([signatures(t).astype(np.int64) for t in texts], dtype=object)

    made = docs.select(F.col(key).alias("doc"), signed(F.col(text)).alias("sigs"))
    # the hash of its set names a node
    made = cut_lineage(made.withColumn("id", F.xxhash64("sigs")))
    sets = cut_lineage(made.groupBy("id").agg(F.first("sigs").alias("sigs"), F.count("*").alias("copies"), F.min("doc").alias("least")))
    links = cut_lineage(similar_sets(sets.filter(F.size("sigs") > 0).select("id", "sigs"), threshold))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = sets.select(F.col("id").alias("b"), "copies")
    linked = both.join(copies, "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("others"))
    nodes = sets.select("id", "copies", "least").join(components(links).withColumnRenamed("node", "id"), "id", "left")
    nodes = cut_lineage(nodes.withColumn("component", F.coalesce("component", "id")).join(linked, "id", "left"))
    names = nodes.groupBy("component").agg(F.min("least").alias("class_id"))
    nodes = nodes.join(names, "component").select("id", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return made.select("doc", "id").join(nodes, "id").select(F.col("doc").alias(key), "class_id", "n_links")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, k, body, guest): rows in ranges of the key, each range closed by a guest copy of the next range's first row.

    Ranges are cut by approximate quantiles, and only the first key of each range goes to the driver. So a row's
    successor stands behind it in its own range, and texts are shuffled once. The last range is closed by the first row.
    """
    # a null key comes before all others
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(k.alias("k"), F.col(key).isNull().alias("unnamed"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()["q"] or []
    rows = rows.withColumn("part", _rank(sorted(set(cuts)), F.col("k")))
    heads = {r["part"]: r["k"] for r in rows.groupBy("part").agg(F.min("k").alias("k")).collect()}  # one number per range
    used = sorted(heads)
    before = {p: used[i - 1] for i, p in enumerate(used)}
    table = spark.createDataFrame([(heads[p], before[p]) for p in used] or [(0, 0)], "head long, previous int")
    rows = rows.join(F.broadcast(table), rows["k"] == table["head"], "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("previous").alias("part"), F.lit(True).alias("guest"))
    copies = F.when(F.col("previous").isNull(), F.array(own)).otherwise(F.array(own, guest))
    return rows.select("k", "unnamed", "body", F.explode(copies).alias("c")).select("c.part", "c.guest", "k", "unnamed", "body")


def _rank(cuts: list[int], value: Column) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``, by halving."""
    if not cuts:
        return F.lit(0)
    table = F.lit(cuts)

    def step(state: Column, _: Column) -> Column:
        mid = F.floor((state["low"] + state["high"]) / 2).cast("int")
        open_ = state["low"] < state["high"]
        below = value < F.get(table, mid)
        return F.struct(
            F.when(open_ & ~below, mid + 1).otherwise(state["low"]).alias("low"), F.when(open_ & below, mid).otherwise(state["high"]).alias("high")
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), start, step)["low"]


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", chain: int = CHAIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: fingerprints of the text and of its edited text, and likenesses.

    The next document is the one behind in ascending (key, text), after the last the first; a single document follows
    itself. ``near_edited`` and ``near_next`` are Jaccard likenesses with the edited and with the next text, whole texts
    throughout. A null text counts as empty; two empty texts are alike (1), an empty and another one are not (0).
    """
    rows = with_following(docs, key, text)
    rows = rows.repartition("part").sortWithinPartitions("part", "guest", "k", "body")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (part, key, unnamed, body, signature)
        for batch in batches:
            out = []
            for part, guest, k, unnamed, body in zip(batch["part"], batch["guest"], batch["k"], batch["unnamed"], batch["body"]):
                if held is not None and held[0] != part:
                    held = None
                if guest and held is None:
                    continue
                now = (part, k, unnamed, body, signatures(body, chain))
                if held is not None:
                    out.append(_row(held, now, chain))
                held = None if guest else now
            yield pd.DataFrame(out, columns=names)

    names = ["k", "unnamed", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "k long, unnamed boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    made = rows.mapInPandas(compare, schema)
    return made.select(F.when(~F.col("unnamed"), F.col("k")).alias(key), *names[2:])


def _row(held: tuple, following: tuple, chain: int) -> tuple:
    _, k, unnamed, body, signature = held
    changed = edited(body, following[3])
    other = signatures(changed, chain)
    return (
        k, unnamed, len(body), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(signature), fingerprint(other),
        jaccard(signature, other), jaccard(signature, following[4]),
    )
