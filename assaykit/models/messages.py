"""Messages of affinity propagation between all pairs of rows, of which only those that can matter are stored.

A pair whose responsibility was never positive and that was never its row's best holds nothing of its own: its responsibility follows from its
similarity and one number of its row, its availability from its column alone. So a row stores the pairs of a list of its nearest rows. The list holds
all that matter as long as no pair beyond it can be among the row's two best, or more similar than the best is good. Lists that get too short are made longer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.blocks import sum_batches
from assaykit.operators.sums import fan_out
from assaykit.table import remove_scratch, scratch_path

LISTED = 64
# rows whose messages one task passes, all pairs of them; rounds that tasks repeat before messages are written; rows of one vector
TABLED = 1024
WRITTEN_EVERY = 10
MOST_ROWS = 1 << 24
STATE = "no long, own double, p double, k array<long>, s array<double>, r array<double>, a array<double>, short boolean"


class _Rows:
    """The stored pairs of some rows: columns ``k``, similarities ``s``, responsibilities ``r`` and availabilities ``a``, one row after the other.

    ``own`` is a row's responsibility for itself, ``p`` the damped sum of its best pairs.
    """

    def __init__(self, no, own, p, length, k, s, r, a) -> None:
        self.no, self.own, self.p, self.length, self.k, self.s, self.r, self.a = no, own, p, length, k, s, r, a
        self.filled = np.flatnonzero(length > 0)
        self.first = (np.cumsum(length) - length)[self.filled]
        self.row = np.repeat(np.arange(len(no)), length)

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> _Rows:
        part = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        flat = [part[n].flatten().to_numpy(zero_copy_only=False).copy() for n in ("k", "s", "r", "a")]
        length = part["k"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return cls(*[part[n].to_numpy(zero_copy_only=False).copy() for n in ("no", "own", "p")], length, *flat)

    def _most(self, v: np.ndarray) -> np.ndarray:
        out = np.full(len(self.no), -np.inf)
        if len(self.first):
            out[self.filled] = np.maximum.reduceat(v, self.first)
        return out

    def _ranked(self, columns: Columns) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every row: its pair with itself, the best and the second best of the others, and where the best is."""
        v = self.a + self.s
        best = self._most(v)
        top = np.flatnonzero(v == best[self.row])
        top = top[np.r_[True, np.diff(self.row[top]) != 0]] if len(top) else top
        v[top] = -np.inf
        return columns.own[self.no] + columns.preference, best, self._most(v), top

    def short(self, columns: Columns) -> np.ndarray:
        """Rows whose second best pair may lie beyond the list, or that may want a pair beyond it more than their best."""
        own, best, second, _ = self._ranked(columns)
        second = np.maximum(np.minimum(own, best), second)
        last = np.full(len(self.no), np.inf)
        last[self.filled] = self.s[self.first + self.length[self.filled] - 1]
        return (self.length < len(columns.own) - 1) & ((second < columns.free.max() + last) | (np.maximum(own, best) < last))

    def respond(self, columns: Columns) -> None:
        keep, own, best, second, top = columns.damping, *self._ranked(columns)
        whole = np.maximum(best, own)
        rival = whole[self.row]
        at = self.row[top]
        rival[top] = np.maximum(second, own)[at]
        self.r = keep * self.r + (1 - keep) * (self.s - rival)
        self.own = keep * self.own + (1 - keep) * (columns.preference - np.where(np.isfinite(best), best, 0.0))
        self.p = keep * self.p + (1 - keep) * whole

    def answer(self, sums: np.ndarray, damping: float) -> None:
        self.a = damping * self.a + (1 - damping) * np.minimum(0.0, sums[self.k] - np.maximum(self.r, 0.0))

    def told(self, n: int) -> np.ndarray:
        """What the rows add to the columns, and their responsibilities for themselves."""
        own = np.zeros(n)
        own[self.no] = self.own
        return np.concatenate([np.bincount(self.k, np.maximum(self.r, 0.0), n), own])

    def longer(self, lists: list, t: int, columns: Columns) -> None:
        """Append what longer lists hold beyond the stored ones; such pairs never had messages of their own."""
        parts = {n: [] for n in "ksra"}
        ends = np.cumsum(self.length)
        for i, (end, n) in enumerate(zip(ends, self.length)):
            for name in parts:
                parts[name].append(getattr(self, name)[end - n : end])
            if lists[i] is not None:
                k, s = lists[i][0][n:], lists[i][1][n:]
                for name, value in zip("ksra", (k, s, (1 - columns.damping**t) * s - self.p[i], columns.free[k])):
                    parts[name].append(value)
                self.length[i] += len(k)
        self.__init__(self.no, self.own, self.p, self.length, *[np.concatenate(parts[n]) for n in "ksra"])

    def batch(self, short: np.ndarray | None = None) -> pa.RecordBatch:
        ends = pa.array(np.r_[0, np.cumsum(self.length)].astype(np.int32))
        flat = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (self.k, self.s, self.r, self.a)]
        short = np.zeros(len(self.no), dtype=bool) if short is None else short
        return pa.RecordBatch.from_arrays([pa.array(self.no), pa.array(self.own), pa.array(self.p), *flat, pa.array(short)], ["no", "own", "p", "k", "s", "r", "a", "short"])


class Columns:
    """One number a row: ``own`` availabilities for itself, ``free`` those of pairs that are not stored, and which rows are exemplars."""

    def __init__(self, n: int, preference: float, damping: float) -> None:
        self.preference, self.damping = preference, damping
        self.own, self.free, self.exemplar, self.stable = np.zeros(n), np.zeros(n), np.zeros(n, dtype=bool), 0

    def take(self, told: np.ndarray) -> np.ndarray:
        """The sums of the columns from what all rows told."""
        others, own = np.split(told, 2)
        sums, keep = others + own, self.damping
        self.own = keep * self.own + (1 - keep) * others
        self.free = keep * self.free + (1 - keep) * np.minimum(0.0, sums)
        now = self.own + own > 0
        self.stable = self.stable + 1 if (now == self.exemplar).all() else 1
        self.exemplar = now
        return sums

    def settled(self, t: int, convergence_iter: int) -> bool:
        return t >= convergence_iter and self.stable >= convergence_iter and bool(self.exemplar.any())


def exemplars(
    lists: DataFrame, n: int, preference: float, damping: float, max_iter: int, convergence_iter: int, longer: Callable[[DataFrame, int], DataFrame] | None,
) -> np.ndarray:
    """The numbers of the exemplars among rows 0 to n - 1, whose nearest rows are ``lists(no, k, s)``, most similar first.

    ``longer(rows(no), length)`` gives longer lists of some rows; without it pairs that are not listed do not exist. A round is one pass that brings back
    two numbers a row. Tasks repeat the last rounds from the messages that were written last, with the columns' sums of those rounds.
    """
    if n > MOST_ROWS:
        raise ValueError(f"affinity propagation of more than {MOST_ROWS} rows")
    zero = F.transform("s", lambda v: F.lit(0.0))
    start = lists.select("no", F.lit(0.0).alias("own"), F.lit(0.0).alias("p"), "k", "s", zero.alias("r"), zero.alias("a"), F.lit(False).alias("short"))
    if n <= TABLED:

        def whole(batches):
            held = [pa.RecordBatch.from_arrays(b.columns, b.schema.names) for b in batches if b.num_rows]
            if not held:
                return
            rows = _Rows.read(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            columns = Columns(n, preference, damping)
            for t in range(1, max_iter + 1):
                rows.respond(columns)
                rows.answer(columns.take(rows.told(n)), damping)
                if columns.settled(t, convergence_iter):
                    break
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(columns.exemplar))], ["no"])

        return np.array([r["no"] for r in start.coalesce(1).mapInArrow(whole, "no long").collect()], dtype=np.int64)
    spark = lists.sparkSession
    limit = None if longer is None else n - 1

    def store(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "messages")
        df.write.parquet(path)
        return spark.read.schema(STATE).parquet(path), path

    state, path = store(start.repartition(spark.sparkContext.defaultParallelism, "no"))
    columns, history, done = Columns(n, preference, damping), [], []
    fan, t = fan_out(state), 1

    def replayed(batch: pa.RecordBatch, first: Columns, sums: list[np.ndarray]) -> _Rows:
        """The rows after the rounds that these columns went through since the messages were written."""
        rows = _Rows.read(batch)
        for columns, one in zip(first, sums):
            rows.respond(columns)
            rows.answer(one, damping)
        return rows

    while t <= max_iter:
        now = _frozen(columns)

        def add(batch, history=list(history), sums=list(done), now=now):
            rows = replayed(batch, history, sums)
            lacking = float(rows.short(now).sum()) if limit else 0.0
            rows.respond(now)
            return np.r_[rows.told(n), lacking]

        told = sum_batches(state, add, 2 * n + 1, fan)
        if told[-1] or len(done) >= WRITTEN_EVERY:

            def after(batches, history=list(history), sums=list(done), now=now):
                for batch in batches:
                    if batch.num_rows:
                        rows = replayed(batch, history, sums)
                        yield rows.batch(rows.short(now) if limit else None)

            state, old = state.mapInArrow(after, STATE), path
            state, path = store(state)
            remove_scratch(spark, old)
            history, done = [], []
        if told[-1]:
            lacking = state.filter("short").select("no", F.size("k").alias("m"))
            length = min(limit, 4 * lacking.agg(F.min("m")).first()[0])
            lacking = lacking.filter(F.col("m") < length).select("no")
            more = longer(lacking, length).select("no", F.col("k").alias("k2"), F.col("s").alias("s2"))

            def extend(batches, t=t, now=now):
                for batch in batches:
                    if batch.num_rows:
                        rows = _Rows.read(batch.select(["no", "own", "p", "k", "s", "r", "a"]))
                        found = zip(batch.column("k2").to_pylist(), batch.column("s2").to_pylist())
                        rows.longer([None if k is None else (np.array(k, dtype=np.int64), np.array(s, dtype=float)) for k, s in found], t - 1, now)
                        yield rows.batch()

            state, old = state.join(more, "no", "left").mapInArrow(extend, STATE), path
            state, path = store(state)
            remove_scratch(spark, old)
            continue
        now.free = None  # rounds that are over need it no more
        history.append(now)
        done.append(columns.take(told[:-1]))
        if columns.settled(t, convergence_iter):
            break
        t += 1
    remove_scratch(spark, path)
    return np.flatnonzero(columns.exemplar)


def _frozen(columns: Columns) -> Columns:
    """What rows need of the columns of a round."""
    out = Columns(0, columns.preference, columns.damping)
    out.own, out.free = columns.own, columns.free
    return out
