"""Data checks: every rule over all rows in one aggregate, one result row per (rule, column)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.table import TableSpec, c, q


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    broken: Column


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def feature_rules(spec: TableSpec, allow_missing: bool = False) -> list[Rule]:
    rules = []
    for name in spec.features:
        x = c(name).cast("double")
        bad = ~is_finite(x)
        if allow_missing:
            bad = x.isNotNull() & ~F.isnan(x) & (F.abs(x) == F.lit(float("inf")))
        rules.append(Rule("feature_not_finite", name, bad))
    return rules


def training_rules(spec: TableSpec, allow_missing: bool = False) -> list[Rule]:
    rules = [Rule("identifier_missing", spec.row_id, c(spec.row_id).isNull())]
    rules += [Rule("target_missing", t, c(t).isNull()) for t in spec.targets]
    return rules + feature_rules(spec, allow_missing)


def range_rules(
    lat: str | None = None,
    lon: str | None = None,
    probability: str | None = None,
    age: str | None = None,
    age_max: str | None = None,
) -> list[Rule]:
    """Coordinates, probabilities and ages outside their domain (NULL also breaks the rule)."""

    def outside(name: str, low: float, high: float) -> Column:
        x = c(name).cast("double")
        return ~F.coalesce(is_finite(x) & x.between(low, high), F.lit(False))

    rules = []
    if lat:
        rules.append(Rule("latitude_range", lat, outside(lat, -90.0, 90.0)))
    if lon:
        rules.append(Rule("longitude_range", lon, outside(lon, -180.0, 180.0)))
    if probability:
        rules.append(Rule("probability_range", probability, outside(probability, 0.0, 1.0)))
    if age:
        rules.append(Rule("age_negative", age, ~F.coalesce(is_finite(c(age)) & (c(age) >= 0), F.lit(False))))
    if age and age_max:
        good = is_finite(c(age_max)) & (c(age_max) >= c(age))
        rules.append(Rule("age_max_below_age", age_max, ~F.coalesce(good, F.lit(False))))
    return rules


def check_rows(df: DataFrame, rules: Sequence[Rule], row_id: str) -> DataFrame:
    """(rule, column, n_bad, first_bad_row) for every rule; one scan, one row of aggregates."""
    aggs = []
    for i, rule in enumerate(rules):
        bad = F.coalesce(rule.broken, F.lit(False))
        aggs += [F.count_if(bad).alias(f"n{i}"), F.min(F.when(bad, c(row_id))).cast("string").alias(f"f{i}")]
    wide = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(r.column).alias("column"),
            F.col(f"n{i}").alias("n_bad"),
            F.col(f"f{i}").alias("first_bad_row"),
        )
        for i, r in enumerate(rules)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicate_rows(df: DataFrame, row_id: str) -> DataFrame:
    """Identifiers that occur more than once."""
    return df.groupBy(c(row_id).alias(row_id)).count().filter("count > 1").withColumnRenamed("count", "n")


def small_classes(df: DataFrame, target: str, least: int = 2) -> DataFrame:
    return df.groupBy(c(target).alias(target)).count().filter(F.col("count") < least).withColumnRenamed("count", "n")


def check_training_table(
    df: DataFrame,
    spec: TableSpec,
    task: str,
    test_size: float = 0.2,
    neighbours: int | None = None,
    allow_missing: bool = False,
) -> DataFrame:
    """All training-table rules as one table; an empty ``n_bad > 0`` selection means the table is usable."""
    result = check_rows(df, training_rules(spec, allow_missing), spec.row_id)
    dup = duplicate_rows(df, spec.row_id).agg(
        F.count("*").alias("n_bad"), F.min(c(spec.row_id)).cast("string").alias("first_bad_row")
    )
    result = result.unionByName(
        dup.select(F.lit("identifier_duplicate").alias("rule"), F.lit(spec.row_id).alias("column"), "n_bad", "first_bad_row")
    )
    usable = df if allow_missing else df.na.drop("any", subset=list(spec.features))
    size = usable.agg(F.count("*").alias("n"))
    train_rows = F.col("n") - F.ceil(F.col("n") * F.lit(test_size))
    size_rules = [("no_usable_row", F.col("n") < 1)]
    if neighbours is not None:
        size_rules.append(("neighbours_above_train_rows", train_rows < neighbours))
    if task == "classification":
        classes = usable.groupBy(c(spec.targets[0]).alias("k")).count().agg(
            F.count("*").alias("classes"), F.count_if(F.col("count") < 2).alias("small"), F.sum("count").alias("n")
        )
        test_rows = F.ceil(F.col("n") * F.lit(test_size))
        checks = [
            ("class_below_two_rows", F.col("small")),
            ("fewer_than_two_classes", (F.col("classes") < 2).cast("long")),
            ("split_smaller_than_classes", (F.least(test_rows, F.col("n") - test_rows) < F.col("classes")).cast("long")),
        ]
        for name, bad in checks:
            result = result.unionByName(
                classes.select(
                    F.lit(name).alias("rule"), F.lit(spec.targets[0]).alias("column"),
                    bad.cast("long").alias("n_bad"), F.lit(None).cast("string").alias("first_bad_row"),
                )
            )
    for name, bad in size_rules:
        result = result.unionByName(
            size.select(
                F.lit(name).alias("rule"), F.lit("*").alias("column"), bad.cast("long").alias("n_bad"),
                F.lit(None).cast("string").alias("first_bad_row"),
            )
        )
    return result


def check_application_table(df: DataFrame, spec: TableSpec, allow_missing: bool = False) -> DataFrame:
    return check_training_table(df, TableSpec(spec.row_id, spec.features), "scoring", 0.0, None, allow_missing)


def require_clean(report: DataFrame) -> None:
    broken = report.filter("n_bad > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}({q(r['column'])}): {r['n_bad']}" for r in broken))
