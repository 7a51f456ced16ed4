"""Profile of a sample table: summary statistics, nulls, correlation, histograms, densities, maps."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.normal import normal_cdf
from assaykit.operators.ordering import exact_quantiles, running_totals
from assaykit.operators.sums import fan_out, sum_arrays
from assaykit.table import c, long_form, numeric_columns


def _names(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns else numeric_columns(df)


def describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles and max, one row per column."""
    names = _names(df, columns)
    probs = [0.25, 0.5, 0.75]
    aggs = []
    for i, n in enumerate(names):
        x = c(n).cast("double")
        aggs += [
            F.count(x).alias(f"count_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev_samp(x).alias(f"std_{i}"),
            F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}"),
        ]
        if not exact:
            aggs.append(F.percentile_approx(x, probs, 10_000).alias(f"p_{i}"))
    wide = df.agg(*aggs)
    if exact:
        found = exact_quantiles(df, names, probs)
        wide = wide.select(
            "*", *[F.array(*[F.lit(v).cast("double") for v in found[n]]).alias(f"p_{i}") for i, n in enumerate(names)]
        )
    parts = {k: k + "_{}" for k in ("count", "mean", "std", "min", "max", "p")}
    out = long_form(wide, names, parts)
    return out.select(
        "feature", "count", "mean", "std", "min",
        F.col("p")[0].alias("q25"), F.col("p")[1].alias("q50"), F.col("p")[2].alias("q75"), "max",
    )


def column_info(df: DataFrame) -> DataFrame:
    """Non-null count and type per column."""
    wide = df.agg(*[F.count(c(n)).alias(f"n_{i}") for i, n in enumerate(df.columns)])
    types = dict(df.dtypes)
    rows = [
        F.struct(F.lit(n).alias("feature"), F.col(f"n_{i}").alias("non_null"), F.lit(types[n]).alias("type"))
        for i, n in enumerate(df.columns)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def null_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: any null, number of nulls and their share."""
    names = list(columns) if columns else df.columns
    wide = df.agg(
        F.count("*").alias("rows"), *[F.count_if(c(n).isNull()).alias(f"n_{i}") for i, n in enumerate(names)]
    )
    rows = [
        F.struct(
            F.lit(n).alias("feature"), (F.col(f"n_{i}") > 0).alias("has_null"), F.col(f"n_{i}").alias("n_null"),
            F.try_divide(F.col(f"n_{i}").cast("double"), F.col("rows").cast("double")).alias("null_ratio"),
        )
        for i, n in enumerate(names)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def null_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return null_summary(df, columns).select("feature", "null_ratio").orderBy(F.desc("null_ratio"), "feature")


def has_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return null_summary(df, columns).agg(F.bool_or("has_null").alias("has_missing"))


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation over pairwise complete rows, in long form (both triangles).

    One pass for the means, which only keep the sums small, and one for the pairwise counts and sums of all columns: four
    numbers a pair come back, whatever the number of rows. A pair without rows or without spread has no correlation.
    """
    names = _names(df, columns)
    d = len(names)
    numbers = df.select(*[c(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])
    row = numbers.agg(F.count("*").alias("rows"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)]).first()
    centre = np.array([row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(d)])

    def add(pdf: pd.DataFrame) -> np.ndarray:
        x = pdf.to_numpy(dtype=float) - centre
        known = (~np.isnan(x)).astype(float)
        x = np.where(known > 0, x, 0.0)
        return np.concatenate([(known.T @ known).ravel(), (x.T @ known).ravel(), ((x * x).T @ known).ravel(), (x.T @ x).ravel()])

    n, s, q, p = (sum_arrays(numbers, add, fan_out(numbers)) if row["rows"] else np.zeros(4 * d * d)).reshape(4, d, d)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = p - s * s.T / n
        var = q - s * s / n
        var = np.where(var > 1e-14 * np.maximum(q, 1e-300), var, 0.0)
        r = cov / np.sqrt(var * var.T)
    cells = [(names[i], names[j], 1.0 if i == j and np.isfinite(r[i, j]) else float(r[i, j]) if np.isfinite(r[i, j]) else None) for i in range(d) for j in range(d)]
    return df.sparkSession.createDataFrame(cells, "feature_a string, feature_b string, corr double")


def histogram(
    df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10, transform: str | None = None
) -> DataFrame:
    """Equal-width bins per column; the last bin is closed. Every bin is present, also empty ones.

    ``transform="log1p"`` bins ln(x+1); values <= -1 have no logarithm and are left out.
    """
    names = _names(df, columns)

    def value(n: str) -> Column:
        x = c(n).cast("double")
        return F.when(x > -1, F.log1p(x)) if transform == "log1p" else x

    bounds = df.agg(
        *[F.min(value(n)).alias(f"lo_{i}") for i, n in enumerate(names)],
        *[F.max(value(n)).alias(f"hi_{i}") for i, n in enumerate(names)],
    ).first()
    cells, frame = [], []
    for i, n in enumerate(names):
        lo, hi = bounds[f"lo_{i}"], bounds[f"hi_{i}"]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        step = (hi - lo) / bins
        slot = F.floor((value(n) - F.lit(lo)) / F.lit(step)).cast("int")
        slot = F.when(slot.isNotNull(), F.least(slot, F.lit(bins - 1)))
        cells.append(F.struct(F.lit(n).alias("feature"), slot.alias("bin")))
        frame += [(n, b, lo + b * step, lo + (b + 1) * step) for b in range(bins)]
    counted = (
        df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").filter("bin is not null")
        .groupBy("feature", "bin").count()
    )
    grid = df.sparkSession.createDataFrame(frame, "feature string, bin int, low double, high double")
    return grid.join(counted, ["feature", "bin"], "left").select(
        "feature", "bin", "low", "high", F.coalesce("count", F.lit(0)).cast("long").alias("n")
    )


def log_invalid(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many values of each column ln(x+1) cannot take."""
    names = _names(df, columns)
    wide = df.agg(*[F.count_if(c(n).cast("double") <= -1).alias(f"n_{i}") for i, n in enumerate(names)])
    return long_form(wide, names, {"n_invalid": "n_{}"})


def probability_table(df: DataFrame, column: str) -> DataFrame:
    """P-P table: plotting position rank/(n+1) against the fitted normal law, one row per distinct value."""
    row = df.agg(
        F.avg(c(column)).alias("m"), F.stddev_pop(c(column)).alias("s"), F.count(c(column)).alias("n")
    ).first()
    ranked = running_totals(df.select(c(column).cast("double").alias("value")), "value", {"n": F.count("*")})
    mean_rank = F.col("n_before") + (F.col("n") + 1) / 2
    z = (F.col("value") - F.lit(row["m"])) / F.lit(row["s"] or None)
    return ranked.select(
        "value", "n", (mean_rank / F.lit(float(row["n"] + 1))).alias("observed"), normal_cdf(z).alias("fitted")
    )


def probability_tables(original: DataFrame, imputed: DataFrame, column: str) -> DataFrame:
    """The P-P tables of a column before and after imputation, tagged by state."""
    a = probability_table(original, column).withColumn("state", F.lit("original"))
    return a.unionByName(probability_table(imputed, column).withColumn("state", F.lit("imputed")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(c(column).alias(column)).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(*[count(c(n)).alias(f"n_{i}") for i, n in enumerate(columns)])
    return long_form(wide, columns, {"n_distinct": "n_{}"})


def ratio_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of two elements; one row, NULLs when x does not vary."""
    a, b = c(x).cast("double"), c(y).cast("double")
    return df.agg(
        F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_count(b, a).alias("n")
    )


def ratio_side(df: DataFrame, x: str, y: str) -> DataFrame:
    """Flag rows above (1) or below (0) the fitted line; nothing is returned for a vertical cloud."""
    line = ratio_line(df, x, y).first()
    if line["slope"] is None:
        return df.limit(0).withColumn("above_line", F.lit(0))
    fitted = F.lit(line["slope"]) * c(x) + F.lit(line["intercept"])
    return df.withColumn("above_line", F.when(c(y) > fitted, 1).otherwise(0))


def kernel_density(df: DataFrame, columns: Sequence[str], label: str, grid_size: int = 50) -> DataFrame:
    """Gaussian density per feature and label group on a fixed grid, Scott bandwidth n^(-1/5) * std.

    Every row adds to ``grid_size`` grid points inside its own task; the shuffle carries partial sums only.
    """
    aggs = []
    for i, n in enumerate(columns):
        x = c(n).cast("double")
        aggs += [F.count(x).alias(f"n_{i}"), F.stddev_samp(x).alias(f"s_{i}"), F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}")]
    stats = df.groupBy(c(label).alias("_g")).agg(*aggs)
    parts, ends = [], []
    for i in range(len(columns)):
        usable = (F.col(f"n_{i}") > 1) & (F.col(f"s_{i}") > 0)
        h = F.when(usable, F.col(f"s_{i}") * F.pow(F.col(f"n_{i}").cast("double"), F.lit(-0.2)))
        parts += [h.alias(f"h_{i}"), (F.col(f"n_{i}") * h * math.sqrt(2 * math.pi)).alias(f"c_{i}")]
        ends += [F.min(F.col(f"lo_{i}") - 3 * h).alias(f"lo_{i}"), F.max(F.col(f"hi_{i}") + 3 * h).alias(f"hi_{i}")]
    bounds = stats.agg(*ends).first()  # one row, whatever the number of groups
    joined = df.join(stats.select("_g", *parts), c(label) == F.col("_g"))
    sums, cells = [], []
    for i, n in enumerate(columns):
        lo, hi = bounds[f"lo_{i}"], bounds[f"hi_{i}"]
        if lo is None:
            continue
        sums.append(F.first(f"c_{i}").alias(f"c_{i}"))
        for k in range(grid_size):
            p = lo + k * (hi - lo) / (grid_size - 1)
            u = (F.lit(p) - c(n)) / F.col(f"h_{i}")
            sums.append(F.sum(F.exp(-u * u / 2)).alias(f"g_{i}_{k}"))
            cells.append(F.struct(
                F.lit(n).alias("feature"), F.lit(k).alias("grid"), F.lit(p).alias("x"),
                (F.col(f"g_{i}_{k}") / F.col(f"c_{i}")).alias("density"),
            ))
    if not sums:
        raise ValueError("no group has two different values")
    dense = joined.groupBy(c(label).alias(label)).agg(*sums)
    return dense.select(c(label), F.explode(F.array(*cells)).alias("s")).select(label, "s.*").filter("density is not null")


def density_grid(df: DataFrame, x: str, y: str, size: int = 100, margin: float = 0.05) -> DataFrame:
    """2-D Gaussian density on a size x size grid (full covariance, bandwidth n^(-1/6)), the exact kernel sum.

    Copies of a position are one weight; every position adds to the grid inside its own task, and the shuffle
    carries one grid of sums a task.
    """
    a, b = c(x).cast("double"), c(y).cast("double")
    s = df.filter(a.isNotNull() & b.isNotNull()).agg(
        F.count("*").alias("n"), F.min(a).alias("x0"), F.max(a).alias("x1"), F.min(b).alias("y0"), F.max(b).alias("y1"),
        F.var_samp(a).alias("vx"), F.var_samp(b).alias("vy"), F.covar_samp(a, b).alias("vxy"),
    ).first()
    dx, dy = (s["x1"] - s["x0"]), (s["y1"] - s["y0"])
    cells = df.filter(a.isNotNull() & b.isNotNull()).groupBy(a.alias("cx"), b.alias("cy")).agg(F.count("*").alias("n"))
    inverse = np.linalg.inv(np.array([[s["vx"], s["vxy"]], [s["vxy"], s["vy"]]]) * s["n"] ** (-1.0 / 3.0))
    norm = math.sqrt(np.linalg.det(inverse)) / (2 * math.pi * s["n"])
    edge = margin * max(dx, dy)
    gx = np.linspace(s["x0"] - edge, s["x1"] + edge, size)
    gy = np.linspace(s["y0"] - edge, s["y1"] + edge, size)

    def spread(batches):
        total = np.zeros((size, size))
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start : start + 512]
                u = gx[:, None] - part["cx"].to_numpy()[None, :]
                v = gy[:, None] - part["cy"].to_numpy()[None, :]
                ex = np.exp(-0.5 * inverse[0, 0] * u**2)
                ey = np.exp(-0.5 * inverse[1, 1] * v**2)
                weight = part["n"].to_numpy()
                if inverse[0, 1] == 0:
                    total += (ex * weight) @ ey.T
                else:
                    for k in range(len(part)):
                        cross = np.exp(-inverse[0, 1] * np.outer(u[:, k], v[:, k]))
                        total += weight[k] * np.outer(ex[:, k], ey[:, k]) * cross
        i, j = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "part": total.ravel()})

    summed = cells.mapInPandas(spread, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("part"))
    return summed.select(
        "i", "j",
        (F.lit(float(gx[0])) + F.col("i") * F.lit(float(gx[1] - gx[0]))).alias("x"),
        (F.lit(float(gy[0])) + F.col("j") * F.lit(float(gy[1] - gy[0]))).alias("y"),
        (F.col("part") * F.lit(norm)).alias("density"),
    )


def map_points(df: DataFrame, lat: str, lon: str, value: str | None = None) -> DataFrame:
    """Longitude, latitude and the mapped value (0.5 when only locations are shown)."""
    mapped = c(value).cast("double") if value else F.lit(0.5)
    return df.filter(c(lat).isNotNull() & c(lon).isNotNull()).select(
        c(lon).cast("double").alias("lon"), c(lat).cast("double").alias("lat"), mapped.alias("value")
    )


def map_tiles(df: DataFrame, lat: str, lon: str, value: str | None = None, degrees: float = 45.0) -> DataFrame:
    """Sample count and mean value per map tile."""
    points = map_points(df, lat, lon, value)
    return points.groupBy(
        F.floor(F.col("lon") / degrees).alias("tile_lon"), F.floor(F.col("lat") / degrees).alias("tile_lat")
    ).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
