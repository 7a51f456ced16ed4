"""Sums over all pairs of positions, for functions that have no shorter form.

Positions are packed into blocks of arrays, and every block of queries meets every block of points in a product of the two small
tables of blocks: nothing but the blocks is stored, and tasks pass on one sum a query. Distances come from a matrix product;
those that its rounding would blur are taken from the coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.table import cut_lineage, written

BLOCK_BYTES = 1 << 21
PART_BYTES = 1 << 26
ROWS = 64
# below this share of the squared lengths a squared distance is summed over the coordinates
BLURRED = 1e-3
# rows of a product that picks pairs, pairs a row that are many, and pairs whose coordinates are held at once
TILE = 128
CROWDED = 64
CANDIDATES = 1 << 15


def pair_distances(x: np.ndarray, y: np.ndarray, step: int = ROWS) -> Iterator[np.ndarray]:
    """Euclidean distances to all of ``y``, ``step`` rows of ``x`` at a time; relative errors stay below 1e-11."""
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    long_x, long_y = (x * x).sum(axis=1), (y * y).sum(axis=1)
    twice, longest = np.ascontiguousarray(-2.0 * y.T), long_y.max()
    for s in range(0, len(x), step):
        rows = x[s : s + step]
        squares = rows @ twice
        squares += long_x[s : s + step, None]
        squares += long_y
        i, j = np.nonzero(squares < BLURRED * (long_x[s : s + step, None] + longest))
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            gap = rows[a] - y[b]
            squares[a, b] = (gap * gap).sum(axis=1)
        yield np.sqrt(squares, out=squares)


def _packed_points(points: DataFrame, rows: int, width: int) -> DataFrame:
    """(m, g, no): blocks of up to ``rows`` positions in the order they come, with their numbers."""

    def pack(batches):
        x, no, size = [], [], 0
        for batch in batches:
            f = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for s in range(0, len(f), rows):
                x.append(f[s : s + rows]), no.append(batch.column(1).slice(s, rows).to_numpy())
                size += len(x[-1])
                if size >= rows:
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([np.concatenate(x).tobytes()], pa.binary()), pa.array([np.concatenate(no).tobytes()], pa.binary())], ["m", "g", "no"])
                    x, no, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([np.concatenate(x).tobytes()], pa.binary()), pa.array([np.concatenate(no).tobytes()], pa.binary())], ["m", "g", "no"])

    return points.select("_f", "_no").mapInArrow(pack, "m int, g binary, no binary")


class RoughSquares:
    """Squared distances of rows ``x`` to all of ``z`` by a matrix product, both centred: picks the pairs worth an exact distance.

    The product is in single precision, with a bound on its rounding; rows for which that bound alone lets many pairs through
    are taken again in double precision.
    """

    def __init__(self, x: np.ndarray, z: np.ndarray) -> None:
        self.x, self.z = x, z
        self.scale = max(float(np.abs(x).max()), float(np.abs(z).max())) or 1.0
        self.tables: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def _table(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if kind not in self.tables:
            x, z = self.x / self.scale, self.z / self.scale
            long_x, long_z = (x * x).sum(axis=1), (z * z).sum(axis=1)
            table = np.empty((z.shape[1] + 1, len(z)), dtype=kind)
            table[:-1], table[-1] = -2.0 * z.T, long_z
            rows = np.ones((len(x), x.shape[1] + 1), dtype=kind)
            rows[:, :-1] = x
            slack = float(np.finfo(kind).eps) * (x.shape[1] + 10) * 2 * (long_x + long_z.max()) + 1e-30
            self.tables[kind] = rows, table, long_x, slack
        return self.tables[kind]

    def within(self, at: slice, bound: np.ndarray, want: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, point, square, slack) of all pairs of some rows whose square may be at most the row's ``bound``.

        With ``want`` a row without a bound takes its ``want`` nearest points and all that may be as near.
        """
        unit = self.scale * self.scale
        for kind in (np.float32, np.float64):
            rows, table, long_x, slack = self._table(kind)
            long_x, slack = long_x[at], slack[at]
            part = rows[at] @ table  # without the length of the row
            limit = bound / unit + slack - long_x
            open_ = np.flatnonzero(np.isinf(bound))
            if want is not None and len(open_) and part.shape[1] > want:
                limit[open_] = np.partition(part[open_], want - 1, axis=1)[:, want - 1].astype(float) + 2 * slack[open_]
            limit = np.minimum(limit, float(np.finfo(np.float32).max)).astype(kind)
            flat = np.flatnonzero(part <= np.nextafter(limit, kind(np.inf))[:, None])
            if kind is np.float64 or len(flat) <= CROWDED * len(part) or not (slack > BLURRED * (limit + long_x)).any():
                break
        i, j = np.divmod(flat, part.shape[1])
        return i, j, (part.ravel()[flat] + long_x[i]) * unit, slack[i] * unit


def exact_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows to rows; squares are added one coordinate after the other."""
    gap = x - y
    gap *= gap
    return np.sqrt(np.cumsum(gap, axis=1)[:, -1])


class Nearest:
    """The ``want`` nearest points of some positions so far, by (distance, number)."""

    def __init__(self, x: np.ndarray, want: int) -> None:
        self.x, self.want = x, want
        self.distance, self.number = np.full((len(x), want), np.inf), np.full((len(x), want), np.iinfo(np.int64).max)

    def add(self, y: np.ndarray, number: np.ndarray) -> None:
        middle = y.mean(axis=0)
        x, z = self.x - middle, y - middle
        reach, far = math.sqrt((z * z).sum(axis=1).max()), np.sqrt((x * x).sum(axis=1))
        # a block whose ball lies beyond the last of a row's list holds nothing for it
        asking = np.flatnonzero(far - reach - 1e-9 * (far + reach) <= self.distance[:, -1])
        if not len(asking):
            return
        rough = RoughSquares(x[asking], z)
        for s in range(0, len(asking), TILE):
            at = asking[s : s + TILE]
            last = self.distance[at, -1]
            i, j, _, _ = rough.within(slice(s, s + TILE), last * last * (1 + 1e-12), self.want)
            for k in range(0, len(i), CANDIDATES):
                self._merge(at, i[k : k + CANDIDATES], j[k : k + CANDIDATES], y, number)

    def _merge(self, at: np.ndarray, i: np.ndarray, j: np.ndarray, y: np.ndarray, number: np.ndarray) -> None:
        touched, i = np.unique(i, return_inverse=True)
        at = at[touched]
        row = np.concatenate([np.repeat(np.arange(len(at)), self.want), i])
        distance = np.concatenate([self.distance[at].ravel(), exact_distances(self.x[at[i]], y[j])])
        number = np.concatenate([self.number[at].ravel(), number[j]])
        order = np.lexsort((number, distance, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.want
        self.distance[at[row[keep]], place[keep]] = distance[order[keep]]
        self.number[at[row[keep]], place[keep]] = number[order[keep]]


def nearest_of_all(spots: DataFrame, points: DataFrame, want: int, width: int, size: int) -> DataFrame:
    """(_f, near): for each position of ``spots(_f)`` the numbers and distances of the ``want`` nearest of ``points(_f, _no, _cell)``, ties by number.

    For many coordinates, where cells rule out little: blocks of queries meet blocks of points, which are cut along the cells.
    """
    rows = max(256, BLOCK_BYTES // (8 * (width + 1)))
    parts = max(1, math.ceil(size * 8 * (width + 1) / PART_BYTES))
    left_parts = max(3 * spots.sparkSession.sparkContext.defaultParallelism, min(1024, math.ceil(size / rows)))
    # few rows a block where there are few rows, so that every core has some; a partition is seldom a tenth larger than others
    small = max(64, min(rows, math.ceil(1.1 * size / left_parts)))
    # checkpoints keep their partitions, which files of a table would not: every task meets about as many blocks
    right = cut_lineage(_packed_points(points.repartitionByRange(parts, "_cell", "_no").sortWithinPartitions("_cell", "_no"), rows, width))
    left = _blocks(spots.select("_f").repartition(left_parts, "_f"), small, width, None)
    left = cut_lineage(left.select(F.expr("uuid()").alias("block"), "n", "f"))

    def search(batches):
        held, best = None, None

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([held]), pa.array([best.distance.tobytes()], pa.binary()), pa.array([best.number.tobytes()], pa.binary())], ["block", "distance", "number"]
            )

        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column(0)[k].as_py()
                if block != held:
                    if best is not None:
                        yield out()
                    held, best = block, Nearest(np.frombuffer(batch.column(2)[k].as_buffer()).reshape(-1, width), want)
                best.add(np.frombuffer(batch.column(4)[k].as_buffer()).reshape(-1, width), np.frombuffer(batch.column(5)[k].as_buffer(), dtype=np.int64))
        if best is not None:
            yield out()

    met = left.hint("shuffle_replicate_nl").crossJoin(right)
    pieces = met.mapInArrow(search, "block string, distance binary, number binary")
    joined = pieces.groupBy("block").agg(F.collect_list(F.struct("distance", "number")).alias("lists")).join(left, "block")

    def unpack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                f = np.frombuffer(batch.column(1)[k].as_buffer())
                lists = batch.column(0)[k].values
                d = np.hstack([np.frombuffer(v.as_buffer()).reshape(-1, want) for v in lists.field(0)])
                n = np.hstack([np.frombuffer(v.as_buffer(), dtype=np.int64).reshape(-1, want) for v in lists.field(1)])
                order = np.lexsort((n, d), axis=1)[:, :want]
                d, n = np.take_along_axis(d, order, axis=1), np.take_along_axis(n, order, axis=1)
                good = np.isfinite(d)
                ends = pa.array(np.r_[0, np.cumsum(good.sum(axis=1))].astype(np.int32))
                spans = pa.array(np.arange(0, len(f) + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(spans, pa.array(f)), pa.ListArray.from_arrays(ends, pa.array(n[good])), pa.ListArray.from_arrays(ends, pa.array(d[good])),
                ], ["_f", "_nos", "_ds"])

    found = joined.select("lists", "f").mapInArrow(unpack, "_f array<double>, _nos array<long>, _ds array<double>")
    return found.select("_f", F.arrays_zip(F.col("_nos").alias("_no"), F.col("_ds").alias("distance")).alias("near"))


def _packed_columns(df: DataFrame, rows: int, width: int) -> DataFrame:
    """(m, one binary column for each column): blocks of up to ``rows`` rows of ``_f`` and of further longs and doubles, in the order they come."""
    names = df.columns

    def pack(batches):
        held, size = [], 0

        def made():
            arrays = [np.concatenate(part) for part in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array([len(arrays[0])], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in arrays]], ["m", *names])

        for batch in batches:
            f = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            rest = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, len(names))]
            for s in range(0, len(f), rows):
                if size + len(f[s : s + rows]) > rows:
                    yield made()
                    held, size = [], 0
                held.append([v[s : s + rows] for v in (f, *rest)])
                size += len(held[-1][0])
        if size:
            yield made()

    return df.mapInArrow(pack, ", ".join(["m int", *[f"`{n}` binary" for n in names]]))


class Lightest:
    """The lightest edge out of each component of some positions so far, by (weight, smaller end, larger end).

    An edge weighs max(distance, core of either end); ``bound`` is the weight of an edge that is known for the row's component.
    """

    def __init__(self, x: np.ndarray, core: np.ndarray, bound: np.ndarray, comp: np.ndarray, number: np.ndarray) -> None:
        self.x, self.core, self.comp, self.number = x, core, comp, number
        self.names, self.code = np.unique(comp, return_inverse=True)
        self.best = np.full(len(self.names), np.inf)
        np.minimum.at(self.best, self.code, bound)
        self.edges: np.ndarray | None = None

    def add(self, y: np.ndarray, core: np.ndarray, comp: np.ndarray, number: np.ndarray) -> None:
        middle = y.mean(axis=0)
        x, z = self.x - middle, y - middle
        reach, far = math.sqrt((z * z).sum(axis=1).max()), np.sqrt((x * x).sum(axis=1))
        bound = self.best[self.code]
        open_ = far - reach - 1e-9 * (far + reach) <= bound
        if (comp == comp[0]).all():
            open_ &= self.comp != comp[0]
        asking = np.flatnonzero(open_ & (self.core <= bound))
        if not len(asking):
            return
        light = np.flatnonzero(core <= bound[asking].max())
        if not len(light):
            return
        y, z, core, comp, number = y[light], z[light], core[light], comp[light], number[light]
        rough = RoughSquares(x[asking], z)
        for s in range(0, len(asking), TILE):
            at = asking[s : s + TILE]
            code = self.code[at]
            bound = self.best[code]
            for k in np.flatnonzero(np.isinf(bound)):
                # some edge of a component that has none bounds the others
                other = np.flatnonzero(comp != self.comp[at[k]])[:1]
                if len(other):
                    self.best[code[k]] = min(self.best[code[k]], self._weigh(at[k : k + 1], other, y, core)[0])
            bound = self.best[code]
            i, j, square, slack = rough.within(slice(s, s + TILE), np.where(np.isinf(bound), -1.0, bound * bound * (1 + 1e-12)))
            keep = (comp[j] != self.comp[at[i]]) & (core[j] <= bound[i])
            i, j, square, slack = i[keep], j[keep], square[keep], slack[keep]
            floor = np.maximum(core[j], self.core[at[i]])
            np.minimum.at(self.best, code[i], np.maximum(np.sqrt(np.maximum(square + slack, 0.0)), floor) * (1 + 1e-12))
            keep = np.maximum(np.sqrt(np.maximum(square - slack, 0.0)) * (1 - 1e-12), floor) <= self.best[code[i]]
            i, j = at[i[keep]], j[keep]
            for k in range(0, len(i), CANDIDATES):
                self._take(i[k : k + CANDIDATES], j[k : k + CANDIDATES], y, core, comp, number)

    def _weigh(self, i: np.ndarray, j: np.ndarray, y: np.ndarray, core: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(exact_distances(self.x[i], y[j]), self.core[i]), core[j])

    def _take(self, i: np.ndarray, j: np.ndarray, y: np.ndarray, core: np.ndarray, comp: np.ndarray, number: np.ndarray) -> None:
        w, code, swap = self._weigh(i, j, y, core), self.code[i], self.number[i] > number[j]
        np.minimum.at(self.best, code, w)
        low, high = np.where(swap, number[j], self.number[i]), np.where(swap, self.number[i], number[j])
        kinds = [("code", "i8"), ("w", "f8"), ("lo", "i8"), ("hi", "i8"), ("clo", "i8"), ("chi", "i8")]
        made = np.empty(len(i), dtype=kinds)
        for name, value in zip(made.dtype.names, (code, w, low, high, np.where(swap, comp[j], self.comp[i]), np.where(swap, self.comp[i], comp[j]))):
            made[name] = value
        made = made[w <= self.best[code]]
        if self.edges is not None:
            made = np.concatenate([self.edges, made])
        made = made[np.lexsort((made["hi"], made["lo"], made["w"], made["code"]))]
        self.edges = made[np.r_[True, np.diff(made["code"]) != 0]] if len(made) else made

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.edges is not None:
            yield from _table(comp=self.names[self.edges["code"]], **{n: self.edges[n] for n in ("w", "lo", "hi", "clo", "chi")})


def lightest_outgoing(asking: DataFrame, nodes: DataFrame, width: int, asked: int, size: int) -> DataFrame:
    """(comp, w, lo, hi, clo, chi): edges from ``asking(_f, core, _radius, comp, _id)`` to positions of other components among
    ``nodes(_f, core, comp, _id, _cell)``, no heavier than ``_radius``; the lightest of every component is among them.

    Numbers name the positions and the components.
    """
    nodes = nodes.withColumn("_no", F.col("_id"))
    return _block_search(
        asking.select("_f", "core", "_radius", "comp", "_id"), nodes, ["_f", "core", "comp", "_id"], width, asked, size, Lightest,
        "comp long, w double, lo long, hi long, clo long, chi long", "comp",
    )


def _block_search(
    asking: DataFrame, points: DataFrame, sent: Sequence[str], width: int, asked: int, size: int, keeper: Callable, schema: str, by: str,
) -> DataFrame:
    """What ``keeper(*asking columns)`` gives out after it was shown the ``sent`` columns of all ``points(_cell, _no, ...)``, block after block.

    For many coordinates: blocks meet as in ``nearest_of_all``. Columns are ``_f``, longs and doubles; rows with equal ``by`` share blocks.
    """
    rows = max(256, BLOCK_BYTES // (8 * (width + 4)))
    parts = max(1, math.ceil(size * 8 * (width + 4) / PART_BYTES))
    left_parts = max(1, min(math.ceil(asked / 16), max(3 * asking.sparkSession.sparkContext.defaultParallelism, min(1024, math.ceil(asked / rows)))))
    small = max(16, min(rows, math.ceil(1.1 * asked / left_parts)))
    kinds = [[np.int64 if dict(df.dtypes)[n] == "bigint" else np.float64 for n in names] for df, names in ((asking, asking.columns), (points, sent))]
    left = asking.repartition(left_parts, asking.columns[-1]).sortWithinPartitions(by)
    left = _packed_columns(left, small, width)
    left = cut_lineage(left.select(F.expr("uuid()").alias("block"), *[F.col(n).alias(f"l{k}") for k, n in enumerate(left.columns[1:])]))
    right = points.repartitionByRange(parts, "_cell", "_no").sortWithinPartitions("_cell", "_no").select(*sent)
    right = cut_lineage(_packed_columns(right, rows, width).drop("m"))
    ends = len(asking.columns)

    def search(batches):
        held, best = None, None

        def read(batch, first, k, types):
            columns = [np.frombuffer(batch.column(first + i)[k].as_buffer(), dtype=kind) for i, kind in enumerate(types)]
            return columns[0].reshape(-1, width), *columns[1:]

        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column(0)[k].as_py()
                if block != held:
                    if best is not None:
                        yield from best.out()
                    held, best = block, keeper(*read(batch, 1, k, kinds[0]))
                best.add(*read(batch, 1 + ends, k, kinds[1]))
        if best is not None:
            yield from best.out()

    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(search, schema)


def _table(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One batch, or none without rows."""
    arrays = [pa.array(np.ascontiguousarray(v)) for v in columns.values()]
    if len(arrays[0]):
        yield pa.RecordBatch.from_arrays(arrays, list(columns))


class _Close:
    """Positions that meet blocks of others; ``pairs`` are those within ``eps``."""

    def __init__(self, x: np.ndarray, eps: float) -> None:
        self.x, self.eps = x, eps

    def pairs(self, asking: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, point) of the close pairs of the rows ``asking``, some rows at a time, in the order of rows and points."""
        if not len(asking):
            return
        middle = y.mean(axis=0)
        x, z = self.x[asking] - middle, y - middle
        reach, far = math.sqrt((z * z).sum(axis=1).max()), np.sqrt((x * x).sum(axis=1))
        near = far - reach - 1e-9 * (far + reach) <= self.eps
        if not near.any():
            return
        asking, rough = asking[near], RoughSquares(x[near], z)
        bound = np.full(TILE, self.eps * self.eps * (1 + 1e-12))
        for s in range(0, len(asking), TILE):
            at = asking[s : s + TILE]
            i, j, square, slack = rough.within(slice(s, s + TILE), bound[: len(at)])
            keep = np.sqrt(np.maximum(square + slack, 0.0)) * (1 + 1e-12) <= self.eps
            open_ = np.flatnonzero(~keep)
            for k in range(0, len(open_), CANDIDATES):
                some = open_[k : k + CANDIDATES]
                keep[some] = exact_distances(self.x[at[i[some]]], y[j[some]]) <= self.eps
            yield at[i[keep]], j[keep]


class _Histogram:
    """How many distances lie in each of ``cells`` equal cells from ``low`` to ``high``, or those distances themselves."""

    def __init__(self, low: float, high: float, cells: int, values: bool, x: np.ndarray, no: np.ndarray) -> None:
        self.low, self.high, self.x, self.values = low, high, x, values
        self.n, self.kept = np.zeros(cells, np.int64), []

    def add(self, y: np.ndarray) -> None:
        for d in pair_distances(self.x, y):
            d = d[(d >= self.low) & (d < self.high)]
            if self.values:
                self.kept.append(d)
            else:
                at = ((d - self.low) * (len(self.n) / (self.high - self.low))).astype(np.int64)
                self.n += np.bincount(np.minimum(at, len(self.n) - 1), minlength=len(self.n))

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.values:
            kept = np.concatenate(self.kept) if self.kept else np.zeros(0)
            yield from _table(at=np.zeros(len(kept), np.int64), n=np.zeros(len(kept), np.int64), d=kept)
        else:
            at = np.flatnonzero(self.n)
            yield from _table(at=at, n=self.n[at], d=np.zeros(len(at)))


def median_distance(points: DataFrame, width: int, size: int, cells: int = 1 << 14, few: int = 20_000) -> tuple[float, float]:
    """The two middle distances of all pairs of ``points(_f, _no, _cell)``, by counts over all pairs in cells that get narrower."""
    high = points.select([F.max(F.abs(F.col("_f")[j])).alias(f"x{j}") for j in range(width)]).first()
    low, high = 0.0, 2.0 * math.sqrt(sum(v * v for v in high)) * (1 + 1e-9) + 1e-300

    def passed(values: bool) -> DataFrame:
        keeper = partial(_Histogram, low, high, cells, values)
        return _block_search(points.select("_f", "_no"), points, ["_f"], width, size, size, keeper, "at long, n long, d double", "_no")

    # a position is at distance 0 from itself, so the first ``size`` distances are no pairs
    pairs = size * (size - 1)
    ranks = [size + (pairs - 1) // 2, size + pairs // 2]
    while True:
        counts = np.zeros(cells, np.int64)
        for r in passed(False).groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row a cell
            counts[r["at"]] = r["n"]
        ends = np.cumsum(counts)
        first, last = (int(np.searchsorted(ends, r, side="right")) for r in ranks)
        below, step = int(ends[first] - counts[first]), (high - low) / cells
        ranks = [r - below for r in ranks]
        inside = int(counts[first : last + 1].sum())
        # a little wider than the cells, so that rounding of their bounds leaves nothing out
        edge = low + first * step, low + (last + 1) * step
        if inside <= few or step <= 1e-9 * high:
            slack = 1e-3 * step
            low, high = edge[0] - slack, edge[1] + slack
            if inside > few:  # as good as equal
                return 0.5 * (edge[0] + edge[1]), 0.5 * (edge[0] + edge[1])
            got = np.sort([r["d"] for r in passed(True).select("d").collect()])
            ranks = [r + int((got < edge[0]).sum()) for r in ranks]
            return tuple(float(got[min(r, len(got) - 1)]) for r in ranks)
        low, high = edge


class _Counts(_Close):
    """How many rows lie within ``eps``; a position that has ``enough`` of them asks no more."""

    def __init__(self, eps: float, enough: float, x: np.ndarray, no: np.ndarray) -> None:
        super().__init__(x, eps)
        self.no, self.enough, self.total = no, enough, np.zeros(len(x))

    def add(self, y: np.ndarray, n: np.ndarray) -> None:
        for i, j in self.pairs(np.flatnonzero(self.total < self.enough), y):
            self.total += np.bincount(i, n[j], len(self.total))

    def out(self) -> Iterator[pa.RecordBatch]:
        some = self.total > 0
        return _table(_no=self.no[some], total=self.total[some])


class _Links(_Close):
    """A link of each position to the first one of another part within ``eps``, named by the two parts."""

    def __init__(self, eps: float, x: np.ndarray, comp: np.ndarray, no: np.ndarray) -> None:
        super().__init__(x, eps)
        self.comp, self.to = comp, np.full(len(x), -1)

    def add(self, y: np.ndarray, comp: np.ndarray) -> None:
        asking = self.to < 0
        if (comp == comp[0]).all():
            asking &= self.comp != comp[0]
        for i, j in self.pairs(np.flatnonzero(asking), y):
            other = self.comp[i] != comp[j]
            row, first = np.unique(i[other], return_index=True)
            self.to[row] = comp[j[other][first]]

    def out(self) -> Iterator[pa.RecordBatch]:
        some = self.to >= 0
        a, b = np.unique(np.stack([self.comp[some], self.to[some]]), axis=1)
        return _table(a=a, b=b)


class _Lowest(_Close):
    """The lowest cluster within ``eps``."""

    def __init__(self, eps: float, x: np.ndarray, no: np.ndarray) -> None:
        super().__init__(x, eps)
        self.no, self.low = no, np.full(len(x), np.iinfo(np.int64).max)

    def add(self, y: np.ndarray, cluster: np.ndarray) -> None:
        for i, j in self.pairs(np.flatnonzero(self.low > cluster.min()), y):
            np.minimum.at(self.low, i, cluster[j])

    def out(self) -> Iterator[pa.RecordBatch]:
        some = self.low < np.iinfo(np.int64).max
        return _table(_no=self.no[some], near=self.low[some])


def counts_within(spots: DataFrame, eps: float, enough: float, width: int, size: int) -> DataFrame:
    """(_no, total): rows within ``eps`` of each of the ``spots(_f, _no, _n, _cell)``; counting may end at ``enough``."""
    points = spots.withColumn("_n", F.col("_n").cast("double"))
    found = _block_search(spots.select("_f", "_no"), points, ["_f", "_n"], width, size, size, partial(_Counts, eps, enough), "_no long, total double", "_no")
    return found.groupBy("_no").agg(F.sum("total").alias("total"))


def links_within(asking: DataFrame, points: DataFrame, eps: float, width: int, asked: int, size: int) -> DataFrame:
    """(a, b): parts that a pair within ``eps`` connects; each of ``asking(_f, comp, _no)`` gives a link to another part among ``points(_f, comp, _no, _cell)``, if it has one."""
    found = _block_search(asking.select("_f", "comp", "_no"), points, ["_f", "comp"], width, asked, size, partial(_Links, eps), "a long, b long", "comp")
    return found.distinct()


def lowest_within(asking: DataFrame, points: DataFrame, eps: float, width: int, asked: int, size: int) -> DataFrame:
    """(_no, near): the lowest cluster among ``points(_f, cluster, _no, _cell)`` within ``eps`` of each of ``asking(_f, _no)``."""
    found = _block_search(asking.select("_f", "_no"), points, ["_f", "cluster"], width, asked, size, partial(_Lowest, eps), "_no long, near long", "_no")
    return found.groupBy("_no").agg(F.min("near").alias("near"))


def _blocks(df: DataFrame, rows: int, width: int, tag: str | None) -> DataFrame:
    """(block, n, f, weight): up to ``rows`` positions of one tag as bytes."""
    columns = [F.col("_f"), F.col("_n").cast("double").alias("_n") if "_n" in df.columns else F.lit(1.0).alias("_n")]
    kind = dict(df.dtypes)[tag] if tag else "int"
    columns.append(F.col(tag).alias("tag") if tag else F.lit(0).alias("tag"))

    def made(x: list, w: list, value) -> pa.RecordBatch:
        f, n = np.concatenate(x), np.concatenate(w)
        return pa.RecordBatch.from_arrays(
            [pa.array([len(n)], pa.int32()), pa.array([f.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), value], ["n", "f", "weight", "tag"]
        )

    def pack(batches):
        held, x, w, size = None, [], [], 0
        for batch in batches:
            f = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
            n, tags = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            codes = tags.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            at = 0
            while at < len(n):
                same = int(np.argmax(codes[at:] != codes[at])) if (codes[at:] != codes[at]).any() else len(n) - at
                value = tags.slice(at, 1)
                if size and (not value.equals(held) or size >= rows):
                    yield made(x, w, held)
                    x, w, size = [], [], 0
                held, take = value, min(same, rows - size)
                x.append(f[at : at + take]), w.append(n[at : at + take])
                size, at = size + take, at + take
        if size:
            yield made(x, w, held)

    packed = df.select(*columns)
    if tag:
        packed = packed.sortWithinPartitions("tag")
    return packed.mapInArrow(pack, f"n int, f binary, weight binary, tag {kind}")


def all_pair_sums(queries: DataFrame, points: DataFrame, weigh: Callable[[np.ndarray], np.ndarray], tag: str | None = None) -> DataFrame:
    """(_f, tag, total): for every position of ``queries(_f)`` the sum of ``_n * weigh(distance)`` over ``points(_f, _n)``, a row for each tag.

    Without a tag there is one row a position.
    """
    spark = queries.sparkSession
    ends = points.agg(F.count("*").alias("n"), F.max(F.size("_f")).alias("d")).first()
    n, width = ends["n"], max(1, ends["d"] or 1)
    rows = max(256, BLOCK_BYTES // (8 * (width + 1)))
    parts = max(1, math.ceil(n * 8 * (width + 1) / PART_BYTES))
    tasks = 3 * spark.sparkContext.defaultParallelism
    kind = dict(points.dtypes)[tag] if tag else "int"
    # few rows a block where there are few rows, so that every core has some
    small = max(64, min(rows, math.ceil(n / tasks)))
    right = _blocks(points.repartition(parts, "_f"), rows, width, tag).select(F.col("n").alias("m"), F.col("f").alias("g"), "weight", "tag")
    left_parts = max(tasks, min(1024, math.ceil(n / rows)))
    left = _blocks(queries.select("_f").repartition(left_parts, "_f"), small, width, None)
    left = written(left.select(F.expr("uuid()").alias("block"), "n", "f").repartition(left_parts))
    right = written(right.repartition(parts))

    def add(batches):
        held, sums = None, {}

        def flush():
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([held] * len(sums), pa.string()), pa.concat_arrays([v for v, _ in sums.values()]), pa.array([t.tobytes() for _, t in sums.values()], pa.binary())],
                    ["block", "tag", "totals"],
                )

        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column(0)[k].as_py()
                if block != held:
                    yield from flush()
                    held, sums = block, {}
                    x = np.frombuffer(batch.column(2)[k].as_buffer()).reshape(-1, width)
                y = np.frombuffer(batch.column(4)[k].as_buffer()).reshape(-1, width)
                w, value = np.frombuffer(batch.column(5)[k].as_buffer()), batch.column(6).slice(k, 1)
                total = np.concatenate([weigh(d) @ w for d in pair_distances(x, y)])
                key = value[0].as_py()
                sums[key] = (value, sums[key][1] + total) if key in sums else (value, total)
        yield from flush()

    # both tables have a row for some thousand positions; the product reads them where they are
    met = left.hint("shuffle_replicate_nl").crossJoin(right)
    pieces = met.mapInArrow(add, f"block string, tag {kind}, totals binary")
    joined = pieces.groupBy("block", "tag").agg(F.collect_list("totals").alias("totals")).join(left, "block")

    def unpack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                f = pa.array(np.frombuffer(batch.column("f")[k].as_buffer()))
                count = len(f) // width
                total = sum(np.frombuffer(t.as_buffer()) for t in batch.column("totals")[k].values)
                offsets = pa.array(np.arange(0, len(f) + 1, width, dtype=np.int32))
                tags = batch.column("tag").slice(k, 1).take(pa.array(np.zeros(count, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, f), tags, pa.array(total)], ["_f", "tag", "total"])

    return joined.select("tag", "totals", "f").mapInArrow(unpack, f"_f array<double>, tag {kind}, total double")
