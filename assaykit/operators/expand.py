"""Polynomial feature columns in order of degree, then position."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.table import c


def polynomial_terms(n: int, degree: int, interaction_only: bool = False, include_bias: bool = True) -> list[tuple[int, ...]]:
    pick = itertools.combinations if interaction_only else itertools.combinations_with_replacement
    start = 0 if include_bias else 1
    return [t for d in range(start, degree + 1) for t in pick(range(n), d)]


def term_name(term: tuple[int, ...], features: Sequence[str]) -> str:
    if not term:
        return "1"
    powers = [(features[i], len(list(g))) for i, g in itertools.groupby(term)]
    return " ".join(n if p == 1 else f"{n}^{p}" for n, p in powers)


def polynomial_features(
    df: DataFrame, features: Sequence[str], degree: int = 2, interaction_only: bool = False,
    include_bias: bool = True, keep: Sequence[str] = (),
) -> DataFrame:
    out = [c(k) for k in keep]
    for term in polynomial_terms(len(features), degree, interaction_only, include_bias):
        product = F.lit(1.0)
        for i in term:
            product = product * c(features[i]).cast("double")
        out.append(product.alias(term_name(term, features)))
    return df.select(*out)
