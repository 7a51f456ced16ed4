"""Rows numbered in an order of their own and paired by their numbers, with little on disk.

Rows are kept in blocks, compressed tables of rows with successive numbers. A pairing sends the blocks and the wanted columns only, without
numbers: these follow from those of the blocks, since the pairing is a formula.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.table import c, remove_scratch, scratch_path

BLOCK_ROWS = 1 << 18
BLOCK_BYTES = 1 << 25
SENT_ROWS = 1 << 13


def _packed(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


@dataclass(frozen=True)
class NumberedRows:
    """Blocks of rows (block, data); block b holds the rows from number ``starts[b]`` on, ``n`` rows in all."""

    blocks: DataFrame
    path: str
    starts: np.ndarray
    n: int
    schema: T.StructType

    def rows(self) -> DataFrame:
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(1):
                    yield from _unpacked(data).to_batches(max_chunksize=SENT_ROWS)

        return self.blocks.mapInArrow(unpack, self.schema)

    def paired(self, names: Sequence[str], step: int, shift: int) -> DataFrame:
        """The rows with further columns ``_o0``, ``_o1``, ...: what row s holds under ``names`` goes to row (step * s + shift) mod n."""
        n, starts, back = self.n, self.starts, pow(step, -1, max(self.n, 1))
        fields = [self.schema[name] for name in names]
        schema = T.StructType([*self.schema.fields, *[T.StructField(f"_o{j}", f.dataType) for j, f in enumerate(fields)]])

        def follow(block: int, size: int, factor: int, offset: int) -> np.ndarray:
            """(factor * i + offset) mod n of the numbers of a block."""
            return ((factor * int(starts[block]) + offset) % n + np.arange(size) * factor) % n

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    own, table = batch.column(0)[k].as_py(), _unpacked(batch.column(1)[k]).select(names)
                    to = np.searchsorted(starts, follow(own, table.num_rows, step, shift), side="right") - 1
                    order = np.argsort(to, kind="stable")
                    table, to = table.take(pa.array(order)).combine_chunks(), to[order]
                    ends = np.flatnonzero(np.r_[np.diff(to) != 0, True]) + 1
                    pieces = [_packed(table.slice(a, b - a)) for a, b in zip(np.r_[0, ends[:-1]], ends)]
                    yield pa.RecordBatch.from_arrays([pa.array(to[ends - 1], pa.int32()), pa.array(np.full(len(ends), own), pa.int32()), pa.array(pieces, pa.binary())], ["block", "source", "data"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, table, pieces = -1, None, []

            def made() -> Iterator[pa.RecordBatch]:
                # pieces lie in the order of the numbers they come from
                order = np.argsort(np.argsort(follow(block, table.num_rows, back, -shift * back)))
                other = pa.concat_tables(pieces).take(pa.array(order))
                yield from pa.table([*table.columns, *other.columns], names=schema.names).combine_chunks().to_batches(max_chunksize=SENT_ROWS)

            for batch in batches:
                for k in range(batch.num_rows):
                    data = _unpacked(batch.column(2)[k])
                    if batch.column(1)[k].as_py() < 0:
                        if table is not None:
                            yield from made()
                        block, table, pieces = batch.column(0)[k].as_py(), data, []
                    else:
                        pieces.append(data)
            if table is not None:
                yield from made()

        pieces = self.blocks.mapInArrow(deal, "block int, source int, data binary")
        both = self.blocks.select("block", F.lit(-1).alias("source"), "data").unionByName(pieces)
        parts = max(len(starts), self.blocks.sparkSession.sparkContext.defaultParallelism)
        return both.repartition(parts, "block").sortWithinPartitions("block", "source").mapInArrow(meet, schema)

    def remove(self) -> None:
        remove_scratch(self.blocks.sparkSession, self.path)


def number_rows(df: DataFrame, order: Sequence[Column], names: Sequence[str]) -> NumberedRows:
    """The columns ``names`` of all rows, numbered in some order; rows that are equal in it are told apart by nothing else."""
    spark, n = df.sparkSession, df.count()
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, len(names)))))
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n / size))
    keys = [f"_k{j}" for j in range(len(order))]
    chosen = df.select(*[c(name).alias(name) for name in names], *[x.alias(k) for k, x in zip(keys, order)])
    schema = T.StructType([f for f in chosen.schema.fields if f.name not in keys])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, place = [], 0, 0

        def made() -> pa.RecordBatch:
            data = _packed(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([place], pa.int32()), pa.array([rows], pa.int64()), pa.array([data], pa.binary())], ["part", "place", "rows", "data"])

        for batch in batches:
            for s in range(0, batch.num_rows, size):
                part = batch.slice(s, size).select(list(names))
                if rows + part.num_rows > size:
                    yield made()
                    held, rows, place = [], 0, place + 1
                held.append(part)
                rows += part.num_rows
        if rows:
            yield made()

    path = scratch_path(spark, "numbered")
    chosen.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(pack, "part int, place int, rows long, data binary").write.parquet(path)
    stored = spark.read.schema("part int, place int, rows long, data binary").parquet(path)
    table = stored.select("part", "place", "rows").orderBy("part", "place").collect()  # one row a block
    sizes = np.array([r["rows"] for r in table], dtype=np.int64)
    named = spark.createDataFrame([(r["part"], r["place"], b) for b, r in enumerate(table)], "part int, place int, block int")
    blocks = stored.join(F.broadcast(named), ["part", "place"]).select("block", "data")
    return NumberedRows(blocks, path, np.cumsum(sizes) - sizes, n, schema)
