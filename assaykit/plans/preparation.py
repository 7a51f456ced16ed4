"""One fitted chain: formulas -> imputation -> scaling -> feature choice -> polynomial terms.

It is fitted on training rows once and then replayed, unchanged, on test, application and streaming rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from assaykit.functions.formula import fit_formulas
from assaykit.operators.expand import polynomial_features
from assaykit.operators.missing import fit_imputer
from assaykit.operators.scaling import fit_scaler
from assaykit.operators.selection import select_for_targets


@dataclass(frozen=True)
class Preparation:
    features: Sequence[str]
    targets: Sequence[str] = ()
    formulas: dict[str, str] = field(default_factory=dict)
    impute: str | None = None
    fill_value: float | None = None
    scale: str | None = None
    k_best: int | None = None
    task: str = "regression"
    degree: int | None = None
    interaction_only: bool = False

    def fit(self, train: DataFrame) -> FittedPreparation:
        steps = []
        features = list(self.features)
        if self.formulas:
            model = fit_formulas(train, self.formulas, self.targets)
            steps.append(model.transform)
            train = model.transform(train)
            features += [n for n in self.formulas if n not in features]
        if self.impute:
            model = fit_imputer(train, features, self.impute, self.fill_value)
            steps.append(model.transform)
            train = model.transform(train)
        if self.scale:
            model = fit_scaler(train, features, self.scale)
            steps.append(model.transform)
            train = model.transform(train)
        if self.k_best:
            features = select_for_targets(train, features, self.targets, self.k_best, self.task)
        if self.degree:
            chosen = tuple(features)
            sample = polynomial_features(train, chosen, self.degree, self.interaction_only, include_bias=False)
            features = sample.columns
            steps.append(Expansion(chosen, self.degree, self.interaction_only))
        return FittedPreparation(tuple(features), tuple(steps))


@dataclass(frozen=True)
class Expansion:
    """Replaces features by their polynomial terms."""

    features: tuple[str, ...]
    degree: int
    interaction_only: bool

    def __call__(self, df: DataFrame) -> DataFrame:
        keep = [n for n in df.columns if n not in self.features]
        return polynomial_features(df, self.features, self.degree, self.interaction_only, include_bias=False, keep=keep)


@dataclass(frozen=True)
class FittedPreparation:
    features: tuple[str, ...]
    steps: tuple

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df
