"""Feature scaling: each method is one aggregate over the training rows and one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.table import c


@dataclass(frozen=True)
class ScalerModel:
    """x -> (x - shift) / scale; a column that does not vary becomes 0."""

    shift: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for n in df.columns:
            if n not in self.shift or self.shift[n] is None:
                out.append(c(n))
                continue
            centred = c(n) - F.lit(float(self.shift[n]))
            out.append((centred / F.lit(float(self.scale[n])) if self.scale[n] else centred * 0.0).alias(n))
        return df.select(*out)

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.select(*[
            (c(n) * F.lit(float(self.scale[n] or 0.0)) + F.lit(float(self.shift[n]))).alias(n)
            if n in self.shift and self.shift[n] is not None else c(n)
            for n in df.columns
        ])


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str, compat_std: bool = False) -> ScalerModel:
    """``minmax``, ``standardize`` (population std) or ``mean_normalization``.

    Mean normalisation divides by the range; ``compat_std=True`` divides by the population std instead.
    """
    names = list(columns)
    aggs = []
    for i, n in enumerate(names):
        x = c(n).cast("double")
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    shift, scale = {}, {}
    for i, n in enumerate(names):
        lo, hi, mean, std = row[f"lo{i}"], row[f"hi{i}"], row[f"m{i}"], row[f"s{i}"]
        spread = None if lo is None else hi - lo
        if method == "minmax":
            shift[n], scale[n] = lo, spread
        elif method == "standardize":
            shift[n], scale[n] = mean, std if spread else 0.0
        elif method in ("mean_normalization", "mean_range"):
            shift[n], scale[n] = mean, (std if compat_std and spread else spread)
        else:
            raise ValueError(f"unknown scaling method {method}")
    return ScalerModel(shift, scale)
