"""Class labels: encode as they are, map, cut at given points or at quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.operators.ordering import exact_quantiles
from assaykit.operators.split import CLASS_LIMIT
from assaykit.table import c


@dataclass(frozen=True)
class LabelModel:
    """How a target column becomes a label and a 0-based code; codes follow ``order``."""

    target: str
    order: tuple
    mapping: dict | None = None
    edges: tuple[float, ...] | None = None
    names: tuple[str, ...] | None = None

    def label(self, df: DataFrame) -> DataFrame:
        """Add ``label`` (what a reader sees)."""
        if self.edges is not None:
            # right-closed intervals, the lowest edge included in the first one
            inner = self.edges[1:-1]
            out = F.lit(self.names[-1])
            for name, edge in reversed(list(zip(self.names[:-1], inner))):
                out = F.when(c(self.target) <= F.lit(float(edge)), name).otherwise(out)
            inside = (c(self.target) >= F.lit(float(self.edges[0]))) & (c(self.target) <= F.lit(float(self.edges[-1])))
            return df.withColumn("label", F.when(inside, out))
        if self.mapping is not None:
            table = df.sparkSession.createDataFrame(
                [(str(k), str(v)) for k, v in self.mapping.items()], "_key string, label string"
            )
            return df.join(F.broadcast(table), c(self.target).cast("string") == F.col("_key"), "left").drop("_key")
        return df.withColumn("label", c(self.target))

    def encode(self, df: DataFrame) -> DataFrame:
        """Add ``label`` and ``code``; a label without a code stays NULL and is found by ``missing``."""
        labelled = self.label(df)
        kind = dict(labelled.dtypes)["label"]
        codes = df.sparkSession.createDataFrame(
            [(str(v), i) for i, v in enumerate(self.order)], "_label string, code int"
        )
        out = labelled.join(F.broadcast(codes), F.col("label").cast("string") == F.col("_label"), "left")
        return out.withColumn("label", F.col("label").cast(kind)).drop("_label")

    def decode(self, df: DataFrame, code: str = "prediction") -> DataFrame:
        codes = df.sparkSession.createDataFrame(
            [(str(v), i) for i, v in enumerate(self.order)], "decoded string, _code int"
        )
        return df.join(F.broadcast(codes), c(code).cast("int") == F.col("_code"), "left").drop("_code")

    def missing(self, df: DataFrame) -> DataFrame:
        """Target values this model gives no label to."""
        return self.label(df).filter("label is null").select(c(self.target)).distinct()

    def mapping_table(self, df: DataFrame) -> DataFrame:
        """custom label, code and row count."""
        return self.encode(df).groupBy("label", "code").agg(F.count("*").alias("n"))


def _require_two(order: Sequence) -> None:
    if len(order) < 2:
        raise ValueError("classification needs at least two classes")


def first_seen_labels(df: DataFrame, target: str, row_order: str) -> LabelModel:
    """Keep the labels; codes follow the first occurrence by ``row_order``."""
    rows = (
        df.groupBy(c(target).alias("v")).agg(F.min(c(row_order)).alias("first"))
        .orderBy("first", "v").limit(CLASS_LIMIT + 1).collect()
    )
    if len(rows) > CLASS_LIMIT:
        raise ValueError(f"{target} has more than {CLASS_LIMIT} classes")
    order = tuple(r["v"] for r in rows)
    _require_two(order)
    return LabelModel(target, order)


def sorted_labels(df: DataFrame, target: str) -> LabelModel:
    """Codes follow the sorted order of the labels."""
    rows = df.select(c(target).alias("v")).distinct().limit(CLASS_LIMIT + 1).collect()
    if len(rows) > CLASS_LIMIT:
        raise ValueError(f"{target} has more than {CLASS_LIMIT} classes")
    return LabelModel(target, tuple(sorted(r["v"] for r in rows)))


def mapped_labels(df: DataFrame, target: str, mapping: dict) -> LabelModel:
    model = LabelModel(target, tuple(dict.fromkeys(str(v) for v in mapping.values())), mapping=dict(mapping))
    lost = [r[0] for r in model.missing(df).limit(10).collect()]
    if lost:
        raise ValueError(f"mapping does not cover: {lost}")
    seen = {r["label"] for r in model.label(df).select("label").distinct().collect()}
    order = tuple(v for v in model.order if v in seen)
    _require_two(order)
    return LabelModel(target, order, mapping=dict(mapping))


def interval_labels(df: DataFrame, target: str, cuts: Sequence[float], names: Sequence[str] | None = None) -> LabelModel:
    if any(a >= b for a, b in zip(cuts, cuts[1:])):
        raise ValueError("cut points must be strictly increasing")
    return _cut(df, target, (-float("inf"), *cuts, float("inf")), names)


def quantile_labels(df: DataFrame, target: str, classes: int, names: Sequence[str] | None = None) -> LabelModel:
    """Equal-share bins with linearly interpolated edges; equal edges are an error."""
    edges = exact_quantiles(df, [target], [i / classes for i in range(classes + 1)])[target]
    if any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("quantile bins have equal edges")
    return _cut(df, target, tuple(edges), names)


def _cut(df: DataFrame, target: str, edges: tuple[float, ...], names: Sequence[str] | None) -> LabelModel:
    names = tuple(names or (f"Class_{i}" for i in range(len(edges) - 1)))
    if len(names) != len(edges) - 1 or len(set(names)) != len(names):
        raise ValueError("one unique name per interval is needed")
    model = LabelModel(target, names, edges=edges, names=names)
    seen = {r["label"] for r in model.label(df).select("label").distinct().collect()}
    if None in seen:
        raise ValueError("some target values fall into no interval")
    order = tuple(v for v in names if v in seen)
    _require_two(order)
    return LabelModel(target, order, edges=edges, names=names)
