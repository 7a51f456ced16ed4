"""Exact order statistics, ranks and running totals without a one-partition window.

Rows are first reduced to distinct values with their weight, so a value held by a third of all
rows is one row; the distinct values are cut into buckets at sampled boundaries, and running
totals inside a bucket are shifted by the totals of the buckets before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.table import c

QUANTILE_ACCURACY = 10_000
# rows of counts that one pass may send to the driver, over all columns
COLLECT_LIMIT = 20_000


def bucket_boundaries(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Increasing inner boundaries that split the values of one column into similar shares."""
    if buckets is None:
        buckets = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(c(value).cast("double"), probs, QUANTILE_ACCURACY).alias("b")).first()
    return sorted(set(row["b"] or []))


def with_bucket(df: DataFrame, value: str, boundaries: Sequence[float], name: str = "_bucket") -> DataFrame:
    """Attach the bucket number of ``value`` (binary search in the JVM)."""
    if not boundaries:
        return df.withColumn(name, F.lit(0.0))
    splits = [-math.inf, *boundaries, math.inf]
    return Bucketizer(splits=splits, inputCol=value, outputCol=name, handleInvalid="keep").transform(df)


def running_totals(
    df: DataFrame,
    value: str,
    sums: dict[str, Column],
    groups: Sequence[str] = (),
    boundaries: Sequence[float] | None = None,
    descending: bool = False,
) -> DataFrame:
    """One row per (group, distinct value) with each sum and the total of the rows before it.

    For every entry ``name`` of ``sums`` the result holds ``name`` and ``name_before``.
    """
    base = df.withColumn(value, c(value).cast("double")).filter(c(value).isNotNull())
    if boundaries is None:
        boundaries = bucket_boundaries(base, value)
    keys = list(groups)
    distinct = base.groupBy(*keys, value).agg(*[s.alias(n) for n, s in sums.items()])
    distinct = with_bucket(distinct, value, boundaries)
    order = c(value).desc() if descending else c(value).asc()
    inside = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    shifted = distinct.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_{n}_in") for n in sums]
    )
    totals = distinct.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(f"_{n}_tot") for n in sums])
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    # at most (number of buckets) rows per group
    across = W.partitionBy(*keys).orderBy(bucket_order).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_{n}_tot").over(across), F.lit(0)).alias(f"_{n}_off") for n in sums]
    )
    joined = shifted.join(offsets, [*keys, "_bucket"])
    return joined.select(
        *keys,
        value,
        *[F.col(n) for n in sums],
        *[(F.col(f"_{n}_in") + F.col(f"_{n}_off")).alias(f"{n}_before") for n in sums],
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], collect_limit: int = COLLECT_LIMIT
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles, equal to sorting the whole column.

    A quantile between two rows needs the values at two ranks. See ``_values_at_ranks`` for the passes.
    """
    names = list(columns)
    first = _first_pass(df, names, probs)
    places = {n: [p * (first[f"n{i}"] - 1) for p in probs] if first[f"n{i}"] else [] for i, n in enumerate(names)}
    ranks = {n: sorted({r for x in at for r in (math.floor(x), math.ceil(x))}) for n, at in places.items()}
    found = _values_at_ranks(df, ranks, first, probs, collect_limit)
    out: dict[str, list[float | None]] = {}
    for n in names:
        out[n] = [None] * len(probs)
        for j, x in enumerate(places[n]):
            low, high = found[n][math.floor(x)], found[n][math.ceil(x)]
            out[n][j] = low if low == high else low + (high - low) * (x - math.floor(x))
    return out


def order_statistics(
    df: DataFrame, ranks: dict[str, Sequence[int]], collect_limit: int = COLLECT_LIMIT
) -> dict[str, list[float]]:
    """The values at the given 0-based ranks of each column (NULLs are not counted).

    A rank list may be given as a function of the number of values.
    """
    names = list(ranks)
    sizes = df.agg(*[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    ranks = {n: list(r(sizes[f"n{i}"]) if callable(r) else r) for i, (n, r) in enumerate(ranks.items())}
    shares = sorted({r / max(1, sizes[f"n{i}"] - 1) for i, n in enumerate(names) for r in ranks[n]})
    first = _first_pass(df, names, shares)
    found = _values_at_ranks(df, {n: sorted(set(r)) for n, r in ranks.items()}, first, shares, collect_limit)
    return {n: [found[n][r] for r in ranks[n]] for n in names}


def _first_pass(df: DataFrame, names: Sequence[str], probs: Sequence[float]):
    """Counts, ends and, around each share, two approximate quantiles of every column: one row."""
    margin = 4.0 / QUANTILE_ACCURACY
    around = [max(0.0, min(1.0, p + d)) for p in probs for d in (-margin, margin)]
    aggs = []
    for i, n in enumerate(names):
        x = c(n).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if around:
            aggs.append(F.percentile_approx(x, around, QUANTILE_ACCURACY).alias(f"q{i}"))
    return df.agg(*aggs).first()


def _merged(brackets: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint ascending intervals that cover the given ones."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _cell(x: Column, low: float, high: float, cells: int, cuts: Sequence[float]) -> Column:
    """Number of a value's cell inside a bracket: by even steps, or by ``cuts``, each cut being a cell of its own."""
    if low == high:
        return F.lit(0)
    if not cuts:
        # halves first: the width of a bracket may be more than a double holds
        share = (x / 2 - F.lit(low) / 2) / (F.lit(high) / 2 - F.lit(low) / 2)
        return F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")

    def search(start: int, stop: int) -> Column:
        if start == stop:
            return F.lit(2 * start)
        mid = (start + stop) // 2
        return F.when(x == F.lit(cuts[mid]), F.lit(2 * mid + 1)).when(x < F.lit(cuts[mid]), search(start, mid)).otherwise(search(mid + 1, stop))

    return search(0, len(cuts))


def _values_at_ranks(df, ranks, first, probs, collect_limit) -> dict[str, dict[int, float]]:
    """Value at each rank of each column, by narrowing brackets until one value is left in each.

    A pass turns every row into one (column, cell) pair per open column: a gap before, between or behind the brackets,
    or one of the cells that divide a bracket. Only counts and ends per cell come back, ``collect_limit`` rows over all
    columns at most. The cell that holds a rank is its next bracket. A bracket that even steps don't divide (one value
    with most of the rows, far outliers) is divided at approximate quantiles of its rows next time, each of which
    is a cell of its own, so a value that repeats is found however often it does.
    """
    names = list(ranks)
    found: dict[str, dict[int, float]] = {n: {} for n in names}
    open_: dict[str, dict[int, tuple[float, float]]] = {}
    margin = 4.0 / QUANTILE_ACCURACY
    for i, n in enumerate(names):
        total = first[f"n{i}"]
        if not total:
            continue
        open_[n] = {}
        for r in ranks[n]:
            share = r / max(1, total - 1)
            near = min(range(len(probs)), key=lambda j: abs(probs[j] - share))
            low, high = first[f"lo{i}"], first[f"hi{i}"]
            if abs(probs[near] - share) <= margin / 2:
                low = first[f"q{i}"][2 * near] if share > margin else low
                high = first[f"q{i}"][2 * near + 1] if share < 1 - margin else high
            open_[n][r] = (low, high)
    stuck: set[tuple[str, float, float]] = set()
    while open_:
        plan = {n: _merged(list(at.values())) for n, at in open_.items()}
        hard = [(n, low, high) for n, parts in plan.items() for low, high in parts if (n, low, high) in stuck]
        cuts: dict[tuple[str, float, float], list[float]] = {}
        if hard:
            steps = max(3, min(64, collect_limit // (4 * len(hard))))
            aggs = [
                F.percentile_approx(F.when(c(n).cast("double").between(F.lit(low), F.lit(high)), c(n).cast("double")), [t / steps for t in range(steps + 1)], QUANTILE_ACCURACY).alias(f"s{k}")
                for k, (n, low, high) in enumerate(hard)
            ]
            row = df.agg(*aggs).first()
            cuts = {key: sorted(set(row[f"s{k}"])) for k, key in enumerate(hard)}
        n_parts = sum(len(parts) for parts in plan.values())
        cells = max(2, (collect_limit - n_parts) // n_parts - 1)
        tagged = []
        for i, (n, parts) in enumerate(plan.items()):
            x, slot = c(n).cast("double"), None
            for k, (low, high) in enumerate(parts):
                base = k * (cells + 131)  # the gap before a bracket, then its cells
                inside = F.lit(base + 1) + _cell(x, low, high, cells, cuts.get((n, low, high), ()))
                test = F.when(x < F.lit(low), F.lit(base)) if slot is None else slot.when(x < F.lit(low), F.lit(base))
                slot = test.when(x <= F.lit(high), inside)
            slot = slot.otherwise(F.lit(len(parts) * (cells + 131)))
            tagged.append(F.struct(F.lit(i).alias("i"), F.when(x.isNotNull(), slot).alias("slot"), x.alias("x")))
        rows = (
            df.select(F.explode(F.array(*tagged)).alias("s")).filter("s.slot IS NOT NULL").groupBy("s.i", "s.slot")
            .agg(F.count("*").alias("n"), F.min("s.x").alias("lo"), F.max("s.x").alias("hi")).orderBy("i", "slot").collect()
        )
        after: dict[str, dict[int, tuple[float, float]]] = {}
        stuck = set()
        for i, n in enumerate(plan):
            below, cells_of = 0, [r for r in rows if r["i"] == i]
            wanted = sorted(open_[n])
            at = 0
            for r in cells_of:
                while at < len(wanted) and wanted[at] < below + r["n"]:
                    if r["lo"] == r["hi"]:
                        found[n][wanted[at]] = r["lo"]
                    else:
                        was = open_[n][wanted[at]]
                        after.setdefault(n, {})[wanted[at]] = (r["lo"], r["hi"])
                        whole = sum(x["n"] for x in cells_of if was[0] <= x["lo"] and x["hi"] <= was[1])
                        if 2 * r["n"] > whole:
                            stuck.add((n, r["lo"], r["hi"]))
                    at += 1
                below += r["n"]
        open_ = after
    return found
