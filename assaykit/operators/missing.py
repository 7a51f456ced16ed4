"""Fill missing values and test whether the filling changed the distribution of a column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.normal import chi2_tail_1, normal_tail
from assaykit.operators.ordering import bucket_boundaries, exact_quantiles, running_totals
from assaykit.table import c

METHODS = ("mean", "median", "most_frequent", "constant")
BITS_PER_HASH = 128


@dataclass(frozen=True)
class ImputerModel:
    """Fill values learnt from the training rows; ``transform`` works on any table, streaming too."""

    values: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        types = dict(df.dtypes)
        return df.select(*[
            F.coalesce(c(n), F.lit(self.values[n]).cast("double")).alias(n)
            if n in self.values and self.values[n] is not None and types[n] != "string"
            else (F.coalesce(c(n), F.lit(self.values[n])).alias(n) if self.values.get(n) is not None else c(n))
            for n in df.columns
        ])


def fit_imputer(df: DataFrame, columns: Sequence[str], method: str = "mean", value: float | None = None) -> ImputerModel:
    names = list(columns)
    if method == "constant":
        return ImputerModel({n: value for n in names})
    if method == "mean":
        row = df.agg(*[F.avg(c(n)).alias(f"v{i}") for i, n in enumerate(names)]).first()
        return ImputerModel({n: row[f"v{i}"] for i, n in enumerate(names)})
    if method == "median":
        found = exact_quantiles(df, names, [0.5])
        return ImputerModel({n: found[n][0] for n in names})
    if method == "most_frequent":
        return ImputerModel({n: _mode(df, n) for n in names})
    raise ValueError(f"method must be one of {METHODS}")


def _mode(df: DataFrame, name: str):
    """Most frequent value, smallest on ties: a grouped count and a top-1, no value map in one buffer."""
    row = (
        df.filter(c(name).isNotNull()).groupBy(c(name).alias("v")).count()
        .orderBy(F.desc("count"), F.asc("v")).first()
    )
    return row["v"] if row else None


def rank_test_table(df: DataFrame, original: str, imputed: str) -> DataFrame:
    """Kruskal-Wallis H of the known values of a column against the whole filled column.

    The sort runs over distinct values with their two group counts, not over rows.
    """
    tagged = df.select(
        c(imputed).cast("double").alias("value"),
        F.when(c(original).isNotNull(), 1).otherwise(0).alias("a"),
        F.lit(1).alias("b"),
    )
    # a known value is a member of both groups and keeps its value through imputation
    ranked = running_totals(tagged, "value", {"a": F.sum("a"), "b": F.sum("b")})
    return _kruskal(ranked, [])


def _kruskal(ranked: DataFrame, groups: list[str]) -> DataFrame:
    ties = (F.col("a") + F.col("b")).cast("double")
    mid = (F.col("a_before") + F.col("b_before")).cast("double") + (ties + 1) / 2
    sums = ranked.groupBy(*groups).agg(
        F.sum("a").cast("double").alias("na"), F.sum("b").cast("double").alias("nb"),
        F.sum(F.col("a") * mid).alias("ra"), F.sum(F.col("b") * mid).alias("rb"),
        F.sum(ties * ties * ties - ties).alias("tie"),
    )
    n = F.col("na") + F.col("nb")
    spread = F.try_divide(F.col("ra") * F.col("ra"), F.col("na")) + F.try_divide(F.col("rb") * F.col("rb"), F.col("nb"))
    h = F.try_divide(F.lit(12.0), n * (n + 1)) * spread - 3 * (n + 1)
    correction = 1 - F.try_divide(F.col("tie"), n * n * n - n)
    stat = F.try_divide(h, F.when(correction > 0, correction))
    return sums.select(
        *groups, F.col("na").cast("long").alias("n_original"), F.col("nb").cast("long").alias("n_imputed"),
        stat.alias("statistic"), chi2_tail_1(stat).alias("p_value"),
    )


def kruskal_columns(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """One Kruskal-Wallis row per (original column -> imputed column)."""
    out = None
    for original, imputed in pairs.items():
        one = rank_test_table(df, original, imputed).withColumn("feature", F.lit(original))
        out = one if out is None else out.unionByName(one)
    return out


def signed_rank_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Wilcoxon signed rank over rows where both values are known; normal approximation.

    Zero differences are left out. With nothing left the statistic is NULL and ``reason`` says why.
    """
    d = c(a).cast("double") - c(b).cast("double")
    diff = df.select(d.alias("d")).filter("d is not null and d <> 0").select(
        F.abs("d").alias("size"), (F.col("d") > 0).cast("int").alias("up")
    )
    ranked = running_totals(diff, "size", {"n": F.count("*"), "up": F.sum("up")})
    mid = F.col("n_before").cast("double") + (F.col("n") + 1) / 2
    t = F.col("n").cast("double")
    sums = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.sum(F.col("up") * mid).alias("plus"),
        F.sum((F.col("n") - F.col("up")) * mid).alias("minus"), F.sum(t * t * t - t).alias("tie"),
    )
    n = F.col("n")
    stat = F.least("plus", "minus")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48
    z = F.try_divide(stat - n * (n + 1) / 4, F.sqrt(F.when(var > 0, var)))
    return sums.select(
        n.cast("long").alias("n"), stat.alias("statistic"), z.alias("z"),
        F.when(z.isNotNull(), F.least(F.lit(1.0), 2 * normal_tail(z))).alias("p_value"),
        F.when(n == 0, F.lit("no non-zero difference")).alias("reason"),
    )


def half_sample_bits(row_id: str, seed: int, iterations: int) -> list:
    """0/1 membership of a row in each of ``iterations`` half samples: one hash bit per sample."""
    digits = []
    for block in range((iterations + BITS_PER_HASH - 1) // BITS_PER_HASH):
        digest = F.md5(F.concat_ws("-", F.lit(f"{seed}-{block}"), c(row_id).cast("string")))
        digits += [F.instr(F.lit("0123456789abcdef"), F.substring(digest, j + 1, 1)) - 1 for j in range(32)]
    return [F.shiftright(digits[i // 4], i % 4).bitwiseAND(F.lit(1)) for i in range(iterations)]


def monte_carlo_rank_test(
    df: DataFrame, row_id: str, pairs: dict[str, str], iterations: int = 100, seed: int = 2, level: float = 0.05
) -> DataFrame:
    """Mean Kruskal p-value over seeded half samples; a column is rejected when 0 < p < level.

    Rows are not repeated per sample: each distinct value carries one counter per sample.
    """
    out = None
    for original, imputed in pairs.items():
        bits = half_sample_bits(row_id, seed, iterations)
        known = F.when(c(original).isNotNull(), 1).otherwise(0)
        base = df.select(c(imputed).cast("double").alias("value"), known.alias("known"), F.array(*bits).alias("bits"))
        sums = [F.sum(F.col("bits")[i] * F.col("known")).alias(f"a{i}") for i in range(iterations)]
        sums += [F.sum(F.col("bits")[i]).alias(f"b{i}") for i in range(iterations)]
        boundaries = bucket_boundaries(df, imputed)
        per_value = base.groupBy("value").agg(*sums)
        cells = F.array(*[
            F.struct(F.lit(i).alias("iteration"), F.col(f"a{i}").alias("ca"), F.col(f"b{i}").alias("cb"))
            for i in range(iterations)
        ])
        tall = per_value.select("value", F.explode(cells).alias("s")).select("value", "s.*").filter("cb > 0")
        ranked = running_totals(
            tall, "value", {"a": F.sum("ca"), "b": F.sum("cb")}, groups=["iteration"], boundaries=boundaries
        )
        one = _kruskal(ranked, ["iteration"]).agg(
            F.avg("p_value").alias("mean_p"), F.count("p_value").alias("iterations"),
        ).withColumn("feature", F.lit(original))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("rejected", (F.col("mean_p") > 0) & (F.col("mean_p") < level))


