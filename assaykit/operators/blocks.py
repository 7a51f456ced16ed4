"""Rows in blocks: numpy arrays of some thousand rows as bytes, so iterative fits read them without taking rows apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 8192


def pack(
    df: DataFrame, make: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], names: Sequence[str], block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Blocks of what ``make`` returns for the columns of up to ``block_rows`` rows: ``n`` and one binary column for each name.

    Blocks are dealt to all tasks: a file with one row group is read by one task, however many pieces it is cut into.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                made = make({f: part.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(part.schema.names)})
                columns = [pa.array([part.num_rows], pa.int32()), *[pa.array([np.ascontiguousarray(made[x]).tobytes()], pa.binary()) for x in names]]
                yield pa.RecordBatch.from_arrays(columns, ["n", *names])

    blocks = df.mapInArrow(run, ", ".join(["n int", *[f"{x} binary" for x in names]]))
    return blocks.repartition(max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism))


def each(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[str, bytes]]]:
    """The blocks of a batch: their rows and their bytes."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        yield batch.column(0)[i].as_py(), {x: batch.column(j)[i].as_buffer() for j, x in enumerate(names) if j}


def update(blocks: DataFrame, change: Callable[[int, dict[str, bytes]], dict[str, np.ndarray]]) -> DataFrame:
    """The blocks with some of their arrays replaced."""
    names = blocks.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, parts in each(batch):
                fresh = change(n, parts)
                columns = [pa.array([n], pa.int32())]
                columns += [pa.array([np.ascontiguousarray(fresh[x]).tobytes() if x in fresh else parts[x].to_pybytes()], pa.binary()) for x in names]
                yield pa.RecordBatch.from_arrays(columns, ["n", *names])

    return blocks.mapInArrow(run, blocks.schema)


def sum_blocks(blocks: DataFrame, add: Callable[[int, dict[str, bytes]], np.ndarray], width: int, fan: int = 1) -> np.ndarray:
    """Sum of ``add(rows, arrays)`` over all blocks; a task passes on one array, and with ``fan`` these are added in two steps."""

    def all_of(batch: pa.RecordBatch) -> np.ndarray | None:
        total = None
        for n, parts in each(batch):
            one = add(n, parts)
            total = one if total is None else total + one
        return total

    return sum_batches(blocks, all_of, width, fan)


def sum_batches(df: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray | None], width: int, fan: int = 1) -> np.ndarray:
    """Sum of ``add(batch)`` over all batches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            one = add(batch) if batch.num_rows else None
            if one is not None:
                total = one if total is None else total + one
        if total is not None:
            slot = TaskContext.get().partitionId() % fan
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["slot", "part"])

    pieces = df.mapInArrow(run, "slot int, part array<double>").select("slot", array_to_vector("part").alias("v"))
    if fan > 1:
        pieces = pieces.groupBy("slot").agg(Summarizer.sum(F.col("v")).alias("v"))
    row = pieces.agg(Summarizer.sum(F.col("v")).alias("v")).first()
    if row["v"] is None or row["v"].size == 0:
        return np.zeros(width)
    return row["v"].toArray()
