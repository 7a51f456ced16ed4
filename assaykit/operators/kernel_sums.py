"""Sums of a smooth kernel over all rows, without pairs.

``1 / (1 + (distance / scale)^2)`` is analytic: between a row and a square no wider than ``scale``, or one that lies a square away,
it is a polynomial of degree ``NODES - 1`` per coordinate up to the rounding of doubles. So each square keeps what its rows
weigh at ``NODES`` Chebyshev points per coordinate, four squares give the one above them, and a row meets a bounded number of
squares: those around its own, and at every level those that the level above could not take yet.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.table import cut_lineage

NODES = 24
# values at Chebyshev points that may reach the driver and travel to every task: 128 MB
MAX_VALUES = 1 << 24
MAX_SIDE = 1 << 30
STEP = 1 << 16
ROWS_PER_TASK = 8192
MAX_TASKS = 8192
POINTS = np.cos((2 * np.arange(NODES) + 1) * math.pi / (2 * NODES))


def _basis(x: np.ndarray) -> np.ndarray:
    """The ``NODES`` Lagrange polynomials of the Chebyshev points at x in [-1, 1]."""
    j = np.arange(NODES)
    back = np.cos(j[:, None] * np.arccos(POINTS)[None, :]) * 2.0 / NODES
    back[0] /= 2.0
    return np.cos(j[None, :] * np.arccos(np.clip(x, -1.0, 1.0))[:, None]) @ back


class Level:
    """The squares of one level that hold rows: their numbers, in order, and the values at their points."""

    def __init__(self, at: np.ndarray, values: np.ndarray, low: np.ndarray, side: float) -> None:
        order = np.lexsort((at[:, 1], at[:, 0]))
        self.at, self.values, self.side = at[order], values[order], side
        self.key = self.at[:, 0] * (2 * MAX_SIDE) + self.at[:, 1]
        self.x = low[0] + (self.at[:, :1] + 0.5 + 0.5 * POINTS) * side
        flat = values.shape[2] == 1
        self.y = np.zeros((len(at), 1)) if flat else low[1] + (self.at[:, 1:] + 0.5 + 0.5 * POINTS) * side

    def find(self, at: np.ndarray) -> np.ndarray:
        """Places of those squares that hold rows."""
        key = at[:, 0] * (2 * MAX_SIDE) + at[:, 1]
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return place[(self.key[place] == key) & (at >= 0).all(axis=1)]

    def above(self, low: np.ndarray) -> Level:
        """The level of squares twice as wide; their values follow without error from those of their parts."""
        parent, place = np.unique(self.at // 2, axis=0, return_inverse=True)
        place = place.ravel()
        half = [_basis((POINTS + 2 * o - 1) / 2) for o in (0, 1)]
        out = np.zeros((len(parent), *self.values.shape[1:]))
        for i, j in itertools.product((0, 1), (0, 1)):
            part = np.flatnonzero((self.at[:, 0] % 2 == i) & (self.at[:, 1] % 2 == j))
            for s in range(0, len(part), 1024):
                one = part[s : s + 1024]
                moved = np.einsum("cab,ak->ckb", self.values[one], half[i], optimize=True)
                if self.values.shape[2] > 1:
                    moved = np.einsum("ckb,bl->ckl", moved, half[j], optimize=True)
                np.add.at(out, place[one], moved)
        return Level(parent, out, low, 2 * self.side)


def _around(at: np.ndarray, flat: bool, first: int, last: int) -> np.ndarray:
    span = range(first, last + 1)
    return at + np.array(list(itertools.product(span, (0,) if flat else span)))


def _weigh(x: np.ndarray, y: np.ndarray, own: np.ndarray, levels: list[Level], scale: float) -> np.ndarray:
    """The sum at each place (x, y); all lie in the square ``own`` of the lowest level."""
    total = np.zeros(len(x))
    flat = levels[0].values.shape[2] == 1
    for depth, level in enumerate(levels):
        at = own >> depth
        if depth + 1 < len(levels):
            near = (at >> 1) * 2
            mine = _around(near, flat, -2, 3)
        else:
            mine = level.at
        if depth:
            mine = mine[(np.abs(mine - at) > 1).any(axis=1)]
        cells = level.find(mine)
        width = level.values[0].size
        for s in range(0, len(x), 128):
            rows = slice(s, min(s + 128, len(x)))
            step = max(1, STEP // (width * (rows.stop - s)))
            for c in range(0, len(cells), step):
                some = cells[c : c + step]
                dx, dy = (x[rows, None, None] - level.x[some]) / scale, (y[rows, None, None] - level.y[some]) / scale
                gap = (dx * dx)[:, :, :, None] + (dy * dy + 1.0)[:, :, None, :]
                np.reciprocal(gap, out=gap)
                total[rows] += gap.reshape(rows.stop - s, -1) @ level.values[some].ravel()
    return total


def _pieces(cell: np.ndarray):
    """(start, stop) of equal neighbours."""
    edges = np.flatnonzero(np.diff(cell)) + 1
    return zip(np.r_[0, edges], np.r_[edges, len(cell)])


def _coordinates(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    f = np.stack(pdf["_f"].to_numpy()).astype(float)
    return f[:, 0], f[:, 1] if f.shape[1] > 1 else np.zeros(len(f))


def smooth_sums(spots: DataFrame, scale: float, width: int) -> DataFrame | None:
    """(_f, total): the sum of ``_n / (1 + (distance / scale)^2)`` over all ``spots(_f, _n)`` at each of them, in one or two coordinates.

    Nothing comes back where the rows lie in so many squares that their values are no small table.
    """
    if not 1 <= width <= 2:
        return None
    ends = spots.agg(F.count("*").alias("n"), *[f(F.col("_f")[j]).alias(f"{name}{j}") for j in range(width) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    if not ends["n"]:
        return None
    low = np.array([ends[f"lo{j}"] for j in range(width)] + [0.0] * (2 - width))
    extent = max(ends[f"hi{j}"] - ends[f"lo{j}"] for j in range(width))
    if not extent / scale < MAX_SIDE / 2:
        return None
    spark = spots.sparkSession
    flat, shape = width == 1, (NODES, 1 if width == 1 else NODES)
    number = [F.floor((F.col("_f")[j] - F.lit(float(low[j]))) / F.lit(scale)).alias(f"_c{j}") for j in range(width)]
    placed = spots.select("_f", "_n", *number, *([F.lit(0).cast("long").alias("_c1")] if flat else []))
    if placed.select("_c0", "_c1").distinct().count() * shape[0] * shape[1] > MAX_VALUES:
        return None
    tasks = min(MAX_TASKS, max(3 * spark.sparkContext.defaultParallelism, math.ceil(ends["n"] / ROWS_PER_TASK)))
    placed = cut_lineage(placed.repartitionByRange(tasks, "_c0", "_c1", F.xxhash64("_f")).sortWithinPartitions("_c0", "_c1"))

    def local(v: np.ndarray, c: int, j: int) -> np.ndarray:
        return 2.0 * ((v - low[j]) / scale - c) - 1.0

    def gather(batches):
        held, values = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            (x, y), n = _coordinates(pdf), pdf["_n"].to_numpy(float)
            c0, c1 = pdf["_c0"].to_numpy(), pdf["_c1"].to_numpy()
            for s, e in _pieces(c0 * (2 * MAX_SIDE) + c1):
                at = (int(c0[s]), int(c1[s]))
                if at != held:
                    if held is not None:
                        yield pd.DataFrame({"c0": [held[0]], "c1": [held[1]], "v": [values.tobytes()]})
                    held, values = at, np.zeros(shape)
                other = n[s:e, None] if flat else n[s:e, None] * _basis(local(y[s:e], at[1], 1))
                values += _basis(local(x[s:e], at[0], 0)).T @ other
        if held is not None:
            yield pd.DataFrame({"c0": [held[0]], "c1": [held[1]], "v": [values.tobytes()]})

    parts = placed.mapInPandas(gather, "c0 long, c1 long, v binary").collect()  # one row a square, and a task's ends twice
    found = np.array([(r["c0"], r["c1"]) for r in parts], dtype=np.int64)
    at, place = np.unique(found, axis=0, return_inverse=True)
    values = np.zeros((len(at), *shape))
    for r, i in zip(parts, place.ravel()):
        values[i] += np.frombuffer(r["v"]).reshape(shape)
    levels = [Level(at, values, low, scale)]
    del parts
    while int(levels[-1].at.max()) > 3:
        levels.append(levels[-1].above(low))
    table = spark.sparkContext.broadcast(levels)

    def weigh(batches):
        known = table.value
        corners = None
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = _coordinates(pdf)
            c0, c1 = pdf["_c0"].to_numpy(), pdf["_c1"].to_numpy()
            total = np.zeros(len(x))
            for s, e in _pieces(c0 * (2 * MAX_SIDE) + c1):
                own = np.array([c0[s], c1[s]])
                if e - s <= shape[0] * shape[1]:
                    total[s:e] = _weigh(x[s:e], y[s:e], own, known, scale)
                    continue
                # many rows: the sum itself is as smooth inside a square, so its points give it at every row
                if corners is None or corners[0] != tuple(own):
                    u = low[0] + (own[0] + 0.5 + 0.5 * POINTS) * scale
                    v = np.zeros(1) if flat else low[1] + (own[1] + 0.5 + 0.5 * POINTS) * scale
                    grid = np.repeat(u, len(v)), np.tile(v, len(u))
                    corners = tuple(own), _weigh(*grid, own, known, scale).reshape(shape)
                across = _basis(local(x[s:e], own[0], 0)) @ corners[1]
                total[s:e] = across[:, 0] if flat else (across * _basis(local(y[s:e], own[1], 1))).sum(axis=1)
            yield pd.DataFrame({"_f": pdf["_f"], "total": total})

    return placed.mapInPandas(weigh, "_f array<double>, total double")
