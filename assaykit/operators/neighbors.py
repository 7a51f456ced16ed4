"""Distance joins: k nearest rows, radius sums and sums over all rows, without a cross join.

Points are cut into Voronoi cells around pivots from a bounded sample; every cell knows its radius and, in few dimensions, its
box. A query visits only the cells that can hold an answer by the triangle inequality or the box. Inside a cell a task searches
a ball tree. Cells that hold very many rows are split into hash chunks on both sides, and a task emits per-query results (top k
or sums) instead of pairs. Copies of a point are collapsed to one location with a count first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.table import c, cut_lineage, features_array, q

BLOCK = 2048
# pivots travel to every task; with cells of TREE_BLOCK rows, each with its tree, they reach four billion positions
MAX_CELLS = 1 << 16
TREE_BLOCK = 1 << 16
# boxes bound a cell better than balls in few dimensions only
BOX_DIMENSIONS = 8
LEAF = 256
# beyond so many cells, rows look for theirs in groups of neighbours
NEARBY = 1024
GROUP = 64


@dataclass(frozen=True)
class Cells:
    """Voronoi cells around pivots, with the radius, the box (in few dimensions) and the number of points of each."""

    pivots: np.ndarray
    size: np.ndarray
    radius: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    p: float = 2.0

    @property
    def width(self) -> int:
        return self.pivots.shape[1]

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        if self.width <= BOX_DIMENSIONS and len(self.pivots) > NEARBY:
            for ids, away, reach in self._around(x):
                # the nearest pivot of each row is at most two radii farther from the middle than the middle's own
                near = np.flatnonzero(away <= (away.min() + 2 * reach) * (1 + 1e-9) + 1e-300)
                out[ids] = near[near_squares(x[ids], self.pivots[near]).argmin(axis=1)]
            return out
        step = max(1, (1 << 22) // len(self.pivots))
        for s in range(0, len(x), step):
            out[s : s + step] = near_squares(x[s : s + step], self.pivots).argmin(axis=1)
        return out

    def _around(self, x: np.ndarray):
        """Rows in small groups of neighbours, with the distances of a group's middle to all pivots and its radius."""
        todo = [np.arange(len(x))] if len(x) else []
        while todo:
            ids = todo.pop()
            rows = x[ids]
            if len(ids) > GROUP:
                j = int(np.ptp(rows, axis=0).argmax())
                order = np.argpartition(rows[:, j], len(ids) // 2)
                todo += [ids[order[: len(ids) // 2]], ids[order[len(ids) // 2 :]]]
                continue
            middle = rows.mean(axis=0)[None, :]
            yield ids, distances(middle, self.pivots)[0], float(distances(rows, middle).max())

    def within(self, x: np.ndarray, radius: float, p: float) -> np.ndarray:
        """How many filled cells lie within ``radius`` of each row."""
        out = np.zeros(len(x), dtype=np.int64)
        if p == 2 == self.p and len(self.pivots) > NEARBY:
            groups = ((ids, away - reach - self.radius <= radius * (1 + 1e-9) + 1e-9 * (away + reach + self.radius)) for ids, away, reach in self._around(x))
        else:
            step = max(1, min(512, (1 << 22) // len(self.pivots)))
            groups = ((np.arange(s, min(s + step, len(x))), np.ones(len(self.pivots), dtype=bool)) for s in range(0, len(x), step))
        for ids, near in groups:
            k = np.flatnonzero(near & (self.size > 0))
            some = Cells(self.pivots[k], self.size[k], self.radius[k], *[v if v is None else v[k] for v in (self.low, self.high)], self.p)
            out[ids] = (some.nearest(x[ids], p) <= radius * (1 + 1e-12)).sum(axis=1)
        return out

    def nearest(self, x: np.ndarray, p: float) -> np.ndarray:
        """Smallest possible distance from each row of x to each cell."""
        out = np.zeros((len(x), len(self.pivots)))
        if self.low is not None:
            for j in range(self.width):
                gap = np.maximum(0.0, np.maximum(self.low[None, :, j] - x[:, j, None], x[:, j, None] - self.high[None, :, j]))
                out = np.maximum(out, gap) if math.isinf(p) else out + gap**p
            out = out if math.isinf(p) else out ** (1.0 / p)
        if p == self.p and p >= 1:  # the triangle inequality holds for these distances only
            if p == 2:
                slack = 1e-15 * (self.width + 10) * ((x * x).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1))
                away = np.sqrt(np.maximum(near_squares(x, self.pivots) - slack, 0.0))
            else:
                away = distances(x, self.pivots, p)
            out = np.maximum(out, away - self.radius - 1e-9 * (away + self.radius))
        return out


def near_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by a matrix product; rounding leaves about 1e-12 of the squared lengths."""
    middle = b.mean(axis=0) if len(b) else 0.0
    a, b = a - middle, b - middle
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T), 0.0)


class BallTree:
    """A local tree over the points of one task: halves along the widest coordinate, each with its centre and radius."""

    def __init__(self, y: np.ndarray, p: float) -> None:
        self.y, self.p = y, p
        self.nodes: list[tuple[np.ndarray, float, np.ndarray | None, int, int]] = []
        self._grow(np.arange(len(y)))

    def _grow(self, ids: np.ndarray) -> int:
        at = len(self.nodes)
        rows = self.y[ids]
        centre = rows.mean(axis=0)
        radius = float(distances(rows, centre[None, :], self.p).max())
        self.nodes.append((centre, radius, ids, -1, -1))
        if len(ids) > LEAF and radius > 0:
            j = int(np.ptp(rows, axis=0).argmax())
            order = np.argpartition(rows[:, j], len(ids) // 2)
            left, right = self._grow(ids[order[: len(ids) // 2]]), self._grow(ids[order[len(ids) // 2 :]])
            self.nodes[at] = (centre, radius, None, left, right)
        return at

    def nearest(self, x: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, indices), sorted by both, of the k nearest points of each row; nothing beyond ``limit`` has to be found.

        Missing ones are infinitely far. All rows descend together; a node is left out for the rows it cannot serve.
        """
        n = len(x)
        best = np.full((n, k), np.inf)
        index = np.full((n, k), len(self.y))

        def visit(at: int, rows: np.ndarray, floor: np.ndarray) -> None:
            kth = np.minimum(best[rows, -1], limit[rows])
            go = floor <= kth
            rows = rows[go]
            if not len(rows):
                return
            _, _, ids, left, right = self.nodes[at]
            if ids is not None:
                d, i = _smallest(x[rows], self.y, ids, k, self.p)
                both, names = np.hstack([best[rows], d]), np.hstack([index[rows], i])
                order = np.lexsort((names, both), axis=1)[:, :k]
                best[rows], index[rows] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
                return
            children = []
            for child in (left, right):
                centre, radius, _, _, _ = self.nodes[child]
                away = distances(x[rows], centre[None, :], self.p)[:, 0]
                bound = np.maximum(0.0, away - radius - 1e-9 * (away + radius)) if self.p >= 1 else np.zeros(len(rows))
                children.append((float(away.mean()), child, bound))
            for _, child, bound in sorted(children, key=lambda x: x[:2]):  # the child that is nearer to most comes first
                visit(child, rows, bound)

        if n and len(self.y):
            visit(0, np.arange(n), np.zeros(n))
        return best, index


def _smallest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the points of one leaf, at most k of each row, exact; the product only picks candidates."""
    if p == 2 and len(ids) > k:
        rough = near_squares(x, y[ids])
        scale = 1e-9 * (rough.max(axis=1) + ((y[ids] - y[ids].mean(axis=0)) ** 2).sum(axis=1).max() + 1e-300)
        cut = np.partition(rough, k - 1, axis=1)[:, k - 1] + scale
        width = int((rough <= cut[:, None]).sum(axis=1).max())
        pick = np.argpartition(rough, min(width, len(ids)) - 1, axis=1)[:, :width]
        chosen = ids[pick]
        gap = np.zeros(chosen.shape)
        for j in range(x.shape[1]):
            step = x[:, j, None] - y[chosen, j]
            gap += step * step
        return np.sqrt(gap), chosen
    return distances(x, y[ids], p), np.broadcast_to(ids, (len(x), len(ids)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


def distances(a: np.ndarray, b: np.ndarray, p: float = 2.0) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = np.abs(a[:, j, None] - b[None, :, j])
        out = np.maximum(out, gap) if math.isinf(p) else out + (gap * gap if p == 2 else gap**p)
    return out if math.isinf(p) else (np.sqrt(out) if p == 2 else out ** (1.0 / p))


def _with_cell(df: DataFrame, cells: Cells) -> DataFrame:
    names = df.columns

    def tag(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            yield pdf.assign(_cell=cells.assign(_matrix(pdf["_f"])))[[*names, "_cell"]]

    return df.mapInPandas(tag, _plus_cell(df))


def _plus_cell(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("_cell", T.LongType())])


def build_cells(points: DataFrame, block: int = BLOCK, p: float = 2.0, shape: tuple[int, int] | None = None) -> tuple[DataFrame, Cells]:
    """Tag points (array column ``_f``) with their cell; the pivots come back as a bounded table. ``shape`` saves counting them."""
    if shape is None:
        shape = points.agg(F.count("*").alias("n"), F.max(F.size("_f")).alias("d")).first()
    n, d = shape[0], max(shape[1] or 1, 1)
    wanted = min(MAX_CELLS, max(1, math.ceil(n / block)))
    if wanted == 1:
        # one cell holds everything: nothing rules it out and it needs no pass
        return points.withColumn("_cell", F.lit(0).cast("long")), Cells(np.zeros((1, d)), np.array([n]), np.array([np.inf]), p=p)
    pivots = _matrix(points.select("_f").orderBy(F.xxhash64("_f")).limit(wanted).toPandas()["_f"])
    cells = Cells(pivots, np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), p=p)
    tagged = _with_cell(points, cells)
    boxed = d <= BOX_DIMENSIONS

    def extent(batches):
        size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        low, high = np.full(pivots.shape, np.inf), np.full(pivots.shape, -np.inf)
        for pdf in batches:
            x, at = _matrix(pdf["_f"]), pdf["_cell"].to_numpy()
            size += np.bincount(at, minlength=len(pivots))
            gap = np.abs(x - pivots[at])
            np.maximum.at(radius, at, gap.max(axis=1) if math.isinf(p) else (gap**p).sum(axis=1) ** (1.0 / p))
            if boxed:
                np.minimum.at(low, at, x)
                np.maximum.at(high, at, x)
        k = np.flatnonzero(size)
        if not len(k):  # a partition without rows
            return
        yield pd.DataFrame({"cell": k, "n": size[k], "r": radius[k], "lo": list(low[k]) if boxed else [[]] * len(k), "hi": list(high[k]) if boxed else [[]] * len(k)})

    parts = tagged.select("_f", "_cell").mapInPandas(extent, "cell long, n long, r double, lo array<double>, hi array<double>")
    sides = [F.array(*[f(F.col(name)[j]) for j in range(d)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))] if boxed else []
    size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    low, high = np.full(pivots.shape, np.inf), np.full(pivots.shape, -np.inf)
    for r in parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("r").alias("r"), *sides).collect():  # one row a cell
        size[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
        if boxed:
            low[r["cell"]], high[r["cell"]] = r["lo"], r["hi"]
    return tagged, Cells(pivots, size, radius * (1 + 1e-12), low if boxed else None, high if boxed else None, p)


def block_join(
    queries: DataFrame,
    tagged: DataFrame,
    cells: Cells,
    kernel: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame],
    schema: str,
    radius: str | None = None,
    p: float = 2.0,
    home_only: bool = False,
    block: int = BLOCK,
    point_block: int | None = None,
    allowed: Callable[[pd.DataFrame], np.ndarray] | None = None,
    most: int | None = None,
) -> DataFrame:
    """Run ``kernel(query rows, point rows, query matrix, point matrix)`` on every block pair that matters.

    ``radius`` names a query column; cells farther away than it are skipped. Without it every cell counts. A task gets at
    most about ``block`` queries and ``point_block`` points of a cell. ``allowed(queries)`` may rule out further cells. Where there is one cell,
    ``most`` queries save counting them.
    """
    point_block = point_block or block
    out_schema = _plus_cell(queries)
    names = queries.columns

    def candidates(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            step = max(1, min(512, (1 << 22) // len(cells.size)))
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start : start + step]
                x = _matrix(part["_f"])
                if home_only:
                    yield part.assign(_cell=cells.assign(x))[[*names, "_cell"]]
                    continue
                keep = np.ones((len(x), len(cells.size)), dtype=bool)
                if radius is not None:
                    keep = cells.nearest(x, p) <= part[radius].to_numpy()[:, None] * (1 + 1e-12)
                if allowed is not None:
                    keep &= allowed(part)
                row, cell = np.nonzero(keep & (cells.size > 0)[None, :])
                yield part.iloc[row].assign(_cell=cell.astype(np.int64))[[*names, "_cell"]]

    many = len(cells.size) > 1
    visits = queries.mapInPandas(candidates, out_schema) if many else queries.withColumn("_cell", F.lit(0).cast("long"))
    spark = queries.sparkSession
    counts = {0: most} if most is not None and not many else {r["_cell"]: r["count"] for r in visits.groupBy("_cell").count().collect()}
    plan = [
        (int(k), max(1, math.ceil(v / block)), max(1, math.ceil(int(cells.size[k]) / point_block))) for k, v in counts.items()
    ]
    table = F.broadcast(spark.createDataFrame(plan, "_cell long, _nq int, _np int"))  # one row a cell, at most MAX_CELLS

    def spread(df: DataFrame, own: Column, other: str, own_name: str, other_name: str) -> DataFrame:
        numbered = df.join(table, "_cell").withColumn(own_name, own.cast("int"))
        return numbered.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_nq", "_np")

    left = spread(visits, F.pmod(F.xxhash64("_f"), F.col("_nq")), "_np", "_bq", "_bp")
    point_key = [n for n in tagged.columns if n not in ("_cell",)]
    right = spread(tagged, F.pmod(F.xxhash64(*point_key), F.col("_np")), "_nq", "_bp", "_bq")
    right = right.select(*[c(n).alias(n) for n in right.columns])  # own attribute ids: both sides may share a source
    keys = ["_cell", "_bq", "_bp"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({k: [] for k in [x.split()[0] for x in schema.split(",")]})
        return kernel(a, b, _matrix(a["_f"]), _matrix(b["_f"]))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def placed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose features are all numbers: a row with a missing one (NULL or NaN) has no place and no neighbours."""
    keep = F.lit(True)
    for f in features:
        x = c(f).cast("double")
        keep = keep & x.isNotNull() & ~F.isnan(x)
    return df.filter(keep)


def locations(df: DataFrame, features: Sequence[str], extra: Sequence[Column] = (), by: Sequence[str] = ()) -> DataFrame:
    """Distinct positions with the number of rows there; rows without a place are left out."""
    base = placed(df, features).select(features_array(features).alias("_f"), *[c(b) for b in by], *extra)
    return base.groupBy("_f", *by).agg(F.count("*").alias("_n"))


def nearest_neighbors(
    queries: DataFrame, points: DataFrame, features: Sequence[str], k: int, query_id: str, point_id: str,
    p: float = 2.0, exclude_self: bool = False, payload: Sequence[str] = (), block: int = BLOCK,
) -> DataFrame:
    """(query id, neighbour, distance, rank) for the k nearest rows; ties go to the smaller id. Exact.

    Rows with a missing feature are no neighbours and get none, on either side.
    """
    queries, points = placed(queries, features), placed(points, features)
    want = k + 1 if exclude_self else k
    members = W.partitionBy("_f").orderBy("neighbor")
    pool = points.select(
        features_array(features).alias("_f"), c(point_id).alias("neighbor"), *[c(n) for n in payload]
    ).withColumn("_r", F.row_number().over(members)).filter(F.col("_r") <= want).drop("_r")
    # both sides are read by several jobs below
    pool = cut_lineage(pool)
    tagged, cells = build_cells(pool, block, p)
    spots = cut_lineage(queries.select(features_array(features).alias("_f")).distinct())
    asked = queries.select(c(query_id).alias(query_id), features_array(features).alias("_f"))
    if p == 2 and len(features) > BOX_DIMENSIONS and len(cells.size) > 1:
        from assaykit.operators.all_pairs import nearest_of_all
        from assaykit.operators.graph import number_in_order

        # numbers follow the ids, so ties go to the smaller one
        names = [q(n) for n in tagged.columns if n != "neighbor"]
        numbered = cut_lineage(number_in_order(tagged, "neighbor", names))
        found = nearest_of_all(spots, numbered, want, len(features), int(cells.size.sum()))
        rows = asked.join(found, "_f").select(c(query_id), F.explode("near").alias("_e")).select(c(query_id), "_e._no", "_e.distance")
        rows = rows.join(numbered.select("_no", "neighbor", *[c(n) for n in payload]), "_no").drop("_no")
    else:
        found = _nearest_spots(spots, tagged, cells, want, dict(pool.dtypes), list(payload), p, block)
        rows = asked.join(found, "_f")
    if exclude_self:
        rows = rows.filter(c(query_id) != F.col("neighbor"))
    final = W.partitionBy(query_id).orderBy("distance", "neighbor")
    rows = rows.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return rows.select(query_id, "neighbor", "distance", "rank", *[c(n) for n in payload])


def _nearest_spots(
    spots: DataFrame, tagged: DataFrame, cells: Cells, want: int, kinds: dict[str, str], payload: list[str], p: float, block: int, limit: str | None = None,
) -> DataFrame:
    """(_f, neighbor, distance, payload): the ``want`` nearest points of each position, within the column ``limit`` if one is named."""
    extra = "".join(f", `{n}` {kinds[n]}" for n in payload)
    schema = f"_f array<double>, neighbor {kinds['neighbor']}, distance double{extra}"

    def top(a, b, x, y):
        order = np.argsort(b["neighbor"].to_numpy(), kind="stable")
        b, y = b.iloc[order], y[order]
        far = a["_radius"].to_numpy() * (1 + 1e-12) if "_radius" in a else np.full(len(a), np.inf)
        d, at = BallTree(y, p).nearest(x, min(want, len(b)), far)
        r, k = np.nonzero(np.isfinite(d))
        q = at[r, k]
        out = {"_f": a["_f"].to_numpy()[r], "neighbor": b["neighbor"].to_numpy()[q], "distance": d[r, k]}
        out.update({n: b[n].to_numpy()[q] for n in payload})
        return pd.DataFrame(out)

    rank = W.partitionBy("_f").orderBy("distance", "neighbor")

    def best(df: DataFrame) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= want)

    sizes = {"p": p, "block": block, "point_block": max(block, min(TREE_BLOCK, int(cells.size.max(initial=1))))}
    if limit is None and len(cells.size) > 1:
        # first look into the query's own cell for an upper bound of the k-th distance
        spots = _bounded(spots, best(block_join(spots, tagged, cells, top, schema, home_only=True, **sizes)), want)
        limit = "_radius"
    elif limit is not None:
        spots = spots.withColumn("_radius", F.col(limit))
    return best(block_join(spots, tagged, cells, top, schema, radius=limit and "_radius", **sizes)).drop("_r")


def _bounded(spots: DataFrame, home: DataFrame, want: int) -> DataFrame:
    bound = home.groupBy("_f").agg(F.when(F.count("*") >= want, F.max("distance")).otherwise(F.lit(float("inf"))).alias("_radius"))
    return spots.join(bound, "_f", "left").withColumn("_radius", F.coalesce("_radius", F.lit(float("inf"))))


def cells_visited(queries: DataFrame, points: DataFrame, features: Sequence[str], radius: float, query_id: str, p: float = 2.0, block: int = BLOCK) -> DataFrame:
    """(query id, cells, visited): how many cells the points have, and how many a search within ``radius`` visits for each query."""
    spots = cut_lineage(locations(points, features))
    _, cells = build_cells(spots, block, p)
    rows = placed(queries, features).select(c(query_id).alias(query_id), features_array(features).alias("_f"))
    filled = int((cells.size > 0).sum())

    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({query_id: pdf[query_id], "cells": filled, "visited": cells.within(_matrix(pdf["_f"]), radius, p)})

    return rows.mapInPandas(count, f"`{query_id}` {dict(rows.dtypes)[query_id]}, cells long, visited long")


def sums_over(
    spots: DataFrame, tagged: DataFrame, cells: Cells, weigh: Callable[[np.ndarray], np.ndarray],
    radius: float | None = None, p: float = 2.0, coordinates: bool = False, block: int = BLOCK,
) -> DataFrame:
    """Per query position: sum over points of count * weigh(distance), and optionally the weighted coordinates.

    ``tagged`` holds ``_f`` and ``_n``. The result is keyed by ``_f``. Without a radius no cell can be left out, so blocks of
    positions meet where they are stored.
    """
    if radius is None and p == 2 and not coordinates:
        from assaykit.operators.all_pairs import all_pair_sums

        return all_pair_sums(spots, tagged.select("_f", "_n"), weigh).drop("tag")
    width = cells.width
    names = [f"_s{j}" for j in range(width)] if coordinates else []
    schema = "_f array<double>, total double" + "".join(f", {n} double" for n in names)

    def add(a, b, x, y):
        weight = b["_n"].to_numpy().astype(float)
        total, sums = np.zeros(len(a)), np.zeros((len(a), width))
        for start in range(0, len(a), 256):
            d = distances(x[start : start + 256], y, p)
            w = weigh(d) if radius is None else np.where(d <= radius, weigh(d), 0.0)
            w = w * weight[None, :]
            total[start : start + 256] = w.sum(axis=1)
            if coordinates:
                sums[start : start + 256] = w @ y
        out = {"_f": a["_f"], "total": total}
        out.update({n: sums[:, j] for j, n in enumerate(names)})
        return pd.DataFrame(out)

    if radius is not None:
        spots = spots.withColumn("_radius", F.lit(float(radius)))
    pieces = block_join(spots, tagged, cells, add, schema, radius="_radius" if radius is not None else None, p=p, block=block)
    return pieces.groupBy("_f").agg(F.sum("total").alias("total"), *[F.sum(n).alias(n) for n in names])


def label_distance_sums(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """For every position and cluster the sum of distances to the rows of that cluster.

    Every position meets every block of points, because the plain Euclidean silhouette is defined over all rows; the
    output is positions x clusters, never pairs.
    """
    from assaykit.operators.all_pairs import all_pair_sums

    points = cut_lineage(locations(df, features, by=[label]))
    spots = points.select("_f").distinct()
    return all_pair_sums(spots, points, lambda d: d, label).withColumnRenamed("tag", "other")


def euclidean_silhouette(df: DataFrame, features: Sequence[str], label: str, row_id: str) -> DataFrame:
    """Silhouette per row with plain Euclidean distance; a one-row cluster scores 0."""
    sums = label_distance_sums(df, features, label)
    sizes = df.groupBy(c(label).alias("other")).agg(F.count("*").alias("size"))
    spots = df.select(features_array(features).alias("_f"), c(label).alias("_own")).distinct()
    own = F.col("other") == F.col("_own")
    per_spot = spots.join(sums.join(sizes, "other"), "_f").groupBy("_f", "_own").agg(
        F.max(F.when(own, F.try_divide(F.col("total"), (F.col("size") - 1).cast("double")))).alias("a"),
        F.max(F.when(own, F.col("size"))).alias("size"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"),
    )
    s = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    rows = df.select(c(row_id).alias(row_id), features_array(features).alias("_f"), c(label).alias("_own"))
    return rows.join(per_spot.select("_f", "_own", s.alias("silhouette")), ["_f", "_own"]).select(
        row_id, F.col("_own").alias(label), "silhouette"
    )
