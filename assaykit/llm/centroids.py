"""Centroid clustering in exact integers: nearest centroids found through a vantage-point tree, rebuilt each round."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.table import cut_lineage

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
# centroids of one leaf of the tree
LEAF = 2
# squared distances of components up to this size fit in 63 bits
MAX_COMPONENT = 1 << 27
# bounds of one block of the search, so a large tree needs bounded memory
SEARCH_CELLS = 1 << 20


@dataclass(frozen=True)
class VantageTree:
    """Nodes in arrays. An inner node has a vantage centroid and two children; a leaf has up to ``LEAF`` centroids.

    ``low`` and ``high`` bound the distance of all centroids below a node from the vantage point of its parent.
    """

    points: np.ndarray
    vantage: np.ndarray  # centroid, -1 for a leaf
    near: np.ndarray
    far: np.ndarray
    low: np.ndarray
    high: np.ndarray
    members: list[np.ndarray]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    gap = a - b
    return np.einsum("...j,...j->...", gap, gap)


def build_tree(points: np.ndarray) -> VantageTree:
    """The vantage point is the centroid farthest from the node's first one; the others are halved by their exact distance from it."""
    vantage, near, far, low, high, members = [], [], [], [], [], []

    def add(ids: np.ndarray, bounds: tuple[float, float]) -> int:
        at = len(vantage)
        vantage.append(-1), near.append(-1), far.append(-1), low.append(bounds[0]), high.append(bounds[1]), members.append(ids)
        if len(ids) <= LEAF:
            return at
        v = int(ids[np.argmax(squared(points[ids], points[ids[0]]))])
        rest = ids[ids != v]
        d = squared(points[rest], points[v])
        order = np.lexsort((rest, d))
        half = len(rest) // 2
        vantage[at], members[at] = v, np.empty(0, np.int64)
        for child, chosen in ((near, order[:half]), (far, order[half:])):
            if len(chosen):
                away = np.sqrt(d[chosen].astype(np.float64))
                child[at] = add(rest[chosen], (float(away.min()), float(away.max())))
        return at

    add(np.arange(len(points)), (0.0, np.inf))
    return VantageTree(points, np.array(vantage), np.array(near), np.array(far), np.array(low), np.array(high), members)


def _search(tree: VantageTree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, nodes = len(x), len(tree.vantage)
    best = np.full(n, np.iinfo(np.int64).max)
    label = np.full(n, len(tree.points))
    bound = np.full((n, nodes), np.inf)  # of every node that a row's queue holds
    bound[:, 0] = 0.0
    alive = np.arange(n)

    def offer(rows: np.ndarray, centroid: int) -> np.ndarray:
        d = squared(x[rows], tree.points[centroid])
        better = (d < best[rows]) | ((d == best[rows]) & (centroid < label[rows]))
        best[rows[better]], label[rows[better]] = d[better], centroid
        return d

    while len(alive):
        node = bound[alive].argmin(axis=1)
        least = bound[alive, node]
        # the pruning radius is inclusive: a node as near as the best may hold a smaller number
        go = least <= np.sqrt(best[alive].astype(np.float64)) * (1 + 1e-12)
        alive, node = alive[go], node[go]
        for k in np.unique(node):
            rows = alive[node == k]
            floor = bound[rows, k]
            bound[rows, k] = np.inf
            if tree.vantage[k] < 0:
                for centroid in tree.members[k]:
                    offer(rows, int(centroid))
                continue
            away = np.sqrt(offer(rows, int(tree.vantage[k])).astype(np.float64))
            for child in (tree.near[k], tree.far[k]):
                if child >= 0:
                    gap = np.maximum(away - tree.high[child], tree.low[child] - away)
                    slack = 1e-12 * (away + tree.high[child])  # roots are rounded
                    bound[rows, child] = np.maximum(floor, np.maximum(gap - slack, 0.0))
        alive = alive[np.isfinite(bound[alive]).any(axis=1)]
    return label, best


def nearest(tree: VantageTree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; of equally near ones the smallest number.

    Every row has its own best-first search: it expands the node of its queue with the smallest lower bound until that
    bound passes its best distance. Rows whose next node is the same take the step together. Bounds are rounded
    downwards and distances are integers, so the result is exact.
    """
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    step = max(1, SEARCH_CELLS // len(tree.vantage))
    found = [_search(tree, x[i : i + step]) for i in range(0, len(x), step)]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def integer_rows(column: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have exactly ``dimensions`` components, all finite, and those rows as floor(scale * x)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    right = np.flatnonzero(np.nan_to_num(sizes, nan=-1).astype(np.int64) == dimensions)
    flat = column.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(right), dimensions)
    finite = np.isfinite(flat).all(axis=1)
    whole = np.floor(flat[finite] * scale)
    if len(whole) and np.abs(whole).max() > MAX_COMPONENT:
        raise ValueError(f"a scaled component is beyond {MAX_COMPONENT}: squared distances would not fit a long")
    return right[finite], whole.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(first column, integer components) of the kept rows; the vectors are the last column."""
    for batch in batches:
        at, x = integer_rows(batch.column(batch.num_columns - 1), dimensions, scale)
        if len(at):
            yield batch.column(0).take(pa.array(at)), x


def first_centroids(rows: DataFrame, k: int, dimensions: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` kept vectors with the smallest hex digests of ``seed:id`` in that order; ties by components."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests, x in _blocks(batches, dimensions, scale):
            digest = digests.to_numpy(zero_copy_only=False)
            last = np.sort(digest)[min(k, len(digest)) - 1]
            at = np.flatnonzero(digest <= last)  # rows that share the last digest are told apart by their components later
            yield pa.RecordBatch.from_arrays([pa.array(digest[at], pa.string()), pa.array(list(x[at]), pa.list_(pa.int64()))], ["digest", "v"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = rows.select(digest.alias("digest"), "v").mapInArrow(smallest, "digest string, v array<bigint>").orderBy("digest", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64).reshape(len(found), dimensions)


def _assigned(rows: DataFrame, tree: VantageTree, dimensions: int, scale: int) -> DataFrame:
    """(id, cluster, distance) of every kept row."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dimensions, scale):
            label, away = nearest(sent.value, x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array(away)], ["id", "cluster", "distance"])

    return rows.mapInArrow(assign, f"id {dict(rows.dtypes)['id']}, cluster int, distance bigint")


def _moved(rows: DataFrame, centroids: np.ndarray, dimensions: int, scale: int) -> np.ndarray:
    """Componentwise floor(sum / count) of each non-empty cluster. Tasks add up integers, so nothing depends on their order."""
    k = len(centroids)
    sent = rows.sparkSession.sparkContext.broadcast(build_tree(centroids))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for _, x in _blocks(batches, dimensions, scale):
            label, _ = nearest(sent.value, x)
            count += np.bincount(label, minlength=k)
            for c in np.unique(label):
                total[c] += x[label == c].sum(axis=0)
        c, j = np.nonzero(np.broadcast_to(count[:, None] > 0, total.shape))
        yield pa.RecordBatch.from_pydict({"cluster": c.astype(np.int32), "at": j.astype(np.int32), "n": count[c], "s": total[c, j]})

    sums = rows.select("v").mapInArrow(add, "cluster int, at int, n bigint, s bigint").groupBy("cluster", "at")
    out = centroids.copy()
    # at most clusters x dimensions rows; decimals, so no input is too large for the sums
    for r in sums.agg(*[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in ("n", "s")]).collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // int(r["n"])
    sent.destroy()
    return out


def cluster(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
    scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """One row per kept row of ``vectors``: key, ``cluster``, ``distance`` (squared, exact), ``cluster_inertia``, ``inertia``, ``centroid``.

    Kept are vectors with exactly ``dimensions`` components, none null, NaN or infinite, as integers floor(scale * x). A
    null vector is not kept; a null key is kept and its digest is that of the bare seed; repeated rows are vectors of their
    own; fewer kept vectors than ``k`` give as many centroids; none give an empty result. Other columns are ignored. A
    component beyond ``MAX_COMPONENT`` is an error. Each round reads the vectors once and sends counts and sums only.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    centroids = first_centroids(rows, k, dimensions, scale, seed)
    if not len(centroids):
        none = rows.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
        return none.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.array().cast("array<bigint>").alias("centroid"))
    for _ in range(rounds):
        centroids = _moved(rows, centroids, dimensions, scale)
    placed = cut_lineage(_assigned(rows, build_tree(centroids), dimensions, scale))
    sums = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row a cluster
    whole = sum(r["cluster_inertia"] for r in sums)
    table = [(r["cluster"], r["cluster_inertia"], whole, centroids[r["cluster"]].tolist()) for r in sums]
    facts = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>")
    out = placed.join(F.broadcast(facts), "cluster")
    return out.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
