"""Bootstrap age series: weighted resampling of dated, located samples into age bins."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.operators.checks import check_rows, range_rules, require_clean
from assaykit.operators.kernel_sums import smooth_sums
from assaykit.operators.neighbors import build_cells, locations, sums_over
from assaykit.operators.ordering import bucket_boundaries, running_totals, with_bucket
from assaykit.table import c, cut_lineage, hash_uniform, nan_to_null

# Fixed values of the published weighting: degrees, million years, overall factor.
DEGREE_SCALE = 2.0
AGE_SCALE = 38.0
WEIGHT_FACTOR = 0.2
MAX_BINS = 10_000
MAX_ITERATIONS = 10_000
# up to here all pairs of positions are summed
PAIRED = 20_000
DRAWS_PER_TASK_GROUP = 250_000
# buckets of rows, which the driver and every task know
MAX_BUCKETS = 4096
# draws are passed on in lists of 2-byte places inside as many numbers
CHUNK = 1 << 16
DRAWS_PER_TASK = 500_000


@dataclass(frozen=True)
class SeriesSpec:
    row_id: str = "row_id"
    age: str = "age"
    age_max: str = "age_max"
    probability: str = "probability"
    lat: str = "latitude"
    lon: str = "longitude"
    bin_width: float = 100.0
    iterations: int = 100
    seed: int = 42


def validate(df: DataFrame, spec: SeriesSpec, missing_probability: bool = False) -> int:
    """Check roles and ranges; returns the number of bins."""
    roles = [spec.age, spec.age_max, spec.probability, spec.lat, spec.lon]
    if len(set(roles)) != len(roles):
        raise ValueError("age, maximum age, probability, latitude and longitude must be different columns")
    if not (math.isfinite(spec.bin_width) and spec.bin_width > 0):
        raise ValueError("bin width must be positive")
    if not 1 <= spec.iterations <= MAX_ITERATIONS:
        raise ValueError(f"iterations must be 1..{MAX_ITERATIONS}")
    table = df.filter(c(spec.probability).isNotNull()) if missing_probability else df
    require_clean(check_rows(table, range_rules(spec.lat, spec.lon, spec.probability, spec.age, spec.age_max), spec.row_id))
    top = df.agg(F.max(spec.age_max)).first()[0]
    if top is None or top <= 0:
        raise ValueError("no positive maximum age")
    bins = math.ceil(top / spec.bin_width)
    if bins > MAX_BINS:
        raise ValueError(f"{bins} bins, the limit is {MAX_BINS}")
    return bins


def sample_weights(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Add ``weight`` = 0.2 / sum over all rows of (closeness in space + closeness in age).

    The sum separates into a location part and an age part. Each is computed between distinct positions
    with their row counts, so repeated sites and ages cost nothing extra, and joined back by value. Many positions
    are summed through squares (``smooth_sums``) up to the rounding of doubles, so no pair of them is formed.
    """
    place, age = [spec.lat, spec.lon], [spec.age]

    def part(columns: list[str], scale: float) -> DataFrame:
        spots = cut_lineage(locations(df, columns))
        sums = smooth_sums(spots, scale, len(columns)) if spots.count() > PAIRED else None
        if sums is None:
            tagged, cells = build_cells(spots)
            sums = sums_over(spots.select("_f"), tagged, cells, lambda d: 1.0 / ((d / scale) ** 2 + 1.0))
        return sums.select(*[F.col("_f")[i].alias(n) for i, n in enumerate(columns)], F.col("total").alias("_k_" + columns[0]))

    near_place = part(place, DEGREE_SCALE)
    near_age = part(age, AGE_SCALE)
    keyed = df
    for n in [*place, *age]:
        keyed = keyed.withColumn(n, c(n).cast("double"))
    joined = keyed.join(near_place, place).join(near_age, age)
    total = F.col("_k_" + place[0]) + F.col("_k_" + age[0])
    return joined.withColumn("weight", F.lit(WEIGHT_FACTOR) / total).drop("_k_" + place[0], "_k_" + age[0])


def _jitter(centre: Column, spread: Column, u1: Column, u2: Column) -> Column:
    """Normal draw by Box-Muller from two uniforms."""
    return centre + spread * F.sqrt(-2 * F.ln(1 - u1)) * F.cos(2 * math.pi * u2)


def draw_lists(numbers: DataFrame) -> DataFrame:
    """(_slot, _slice, _chunk, _places) for ``numbers(id, _slot, _slice)``: a number is CHUNK * _chunk + CHUNK / 2 + its place."""

    def made(held: list) -> pa.RecordBatch:
        number, slot, part = (np.concatenate(x) for x in zip(*held))
        chunk = number // CHUNK
        order = np.lexsort((number, part, slot, chunk))
        number, slot, part, chunk = number[order], slot[order], part[order], chunk[order]
        first = np.flatnonzero(np.r_[True, (np.diff(slot) != 0) | (np.diff(part) != 0) | (np.diff(chunk) != 0)])
        places = pa.array((number - chunk * CHUNK - CHUNK // 2).astype(np.int16))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(number)].astype(np.int32)), places)
        return pa.RecordBatch.from_arrays([pa.array(slot[first]), pa.array(part[first]), pa.array(chunk[first]), lists], ["_slot", "_slice", "_chunk", "_places"])

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(i).to_numpy() for i in range(3)])
                size += batch.num_rows
            if size >= CHUNK:
                yield made(held)
                held, size = [], 0
        if size:
            yield made(held)

    return numbers.select("id", "_slot", "_slice").mapInArrow(pack, "_slot double, _slice int, _chunk long, _places array<smallint>")


def draw_plan(cells: DataFrame, whole: float, draws: int) -> tuple[list[float], DataFrame]:
    """Starts of the buckets, and (_slot, _bucket, _slices): into how many slices the draws of a bucket are split."""
    spans = cells.groupBy("_bucket").agg(F.min("_from").alias("lo"), (F.sum("weight") / F.lit(whole)).alias("share")).orderBy("lo").collect()
    plan = [(float(i), float(r["_bucket"]), max(1, math.ceil(r["share"] * draws / DRAWS_PER_TASK_GROUP))) for i, r in enumerate(spans)]
    return [r["lo"] for r in spans], F.broadcast(cells.sparkSession.createDataFrame(plan, "_slot double, _bucket double, _slices int"))


def sliced_rows(weighted: DataFrame, spec: SeriesSpec) -> tuple[DataFrame, DataFrame, list[float], int]:
    """(rows, plan, starts, n): every row with its _slot, _slice and _from, once in each slice of its bucket.

    There are as many buckets as the draws need, so that a bucket has one slice unless a few rows own much of the weight;
    splitting few buckets into many slices would copy every row into each of them.
    """
    base = cut_lineage(weighted.withColumn("_u", hash_uniform(spec.seed, spec.row_id)))
    totals = base.agg(F.sum("weight").alias("w"), F.count("*").alias("n")).first()
    n, whole = totals["n"], totals["w"]
    edges = bucket_boundaries(base, "_u", max(2, min(MAX_BUCKETS, math.ceil(2 * n * spec.iterations / DRAWS_PER_TASK_GROUP))))
    start = running_totals(base, "_u", {"w": F.sum("weight")}, boundaries=edges).select("_u", (F.col("w_before") / F.lit(whole)).alias("_from"))
    cells = cut_lineage(with_bucket(base.join(start, "_u"), "_u", edges))
    starts, plan = draw_plan(cells, whole, n * spec.iterations)
    rows = cells.join(plan, "_bucket").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    return rows, plan.select("_slot", "_slices"), starts, n


def bootstrap_draws(weighted: DataFrame, spec: SeriesSpec) -> DataFrame:
    """n draws with replacement per iteration, proportional to weight: (iteration, draw, age, probability).

    Rows lie in hash order on [0, 1) by cumulative weight; a draw takes the row its uniform falls on. Draws and
    rows meet by a sorted merge inside buckets; a bucket that owns much of the weight is split into slices of
    its draws, each of which sees all of the bucket's rows. Only the numbers of the draws are sent to their buckets, in lists
    of two bytes a draw; their uniforms are hashed again there.
    """
    spark = weighted.sparkSession
    cells, plan, starts, n = sliced_rows(weighted, spec)
    count = n * spec.iterations
    rows = cells.select(
        "_slot", "_slice", F.col("_from").alias("_pos"), F.lit(None).cast("long").alias("_chunk"), F.lit(None).cast("array<smallint>").alias("_places"),
        F.struct(c(spec.age).alias("age"), c(spec.age_max).alias("age_max"), c(spec.probability).alias("probability")).alias("_row"),
    )
    iteration, draw = F.floor(F.col("id") / F.lit(n)).alias("iteration"), (F.col("id") % F.lit(n)).alias("draw")
    cores = spark.sparkContext.defaultParallelism
    numbers = spark.range(0, count, 1, max(3 * cores, math.ceil(count / (8 * DRAWS_PER_TASK)))).select("id", iteration, draw)
    u = numbers.select("id", hash_uniform(f"{spec.seed}-draw", "iteration", "draw").alias("_pos"))
    slots = with_bucket(u, "_pos", sorted(set(starts[1:])), "_slot").join(plan, "_slot")
    lists = draw_lists(slots.select("id", "_slot", F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int").alias("_slice")))
    lists = lists.withColumn("_pos", F.lit(None).cast("double")).withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType))
    # the number of tasks follows the draws, not the size of their lists
    tasks = max(3 * cores, math.ceil(count / DRAWS_PER_TASK))
    # as whole numbers, which the window below takes as they are: it would normalise doubles, and shuffle once more
    both = rows.unionByName(lists).withColumn("_slot", F.col("_slot").cast("int")).repartition(tasks, "_slot", "_slice")
    each = both.select("_slot", "_slice", "_pos", "_row", "_chunk", F.explode_outer("_places").alias("_place"))
    each = each.withColumn("id", F.col("_chunk") * F.lit(CHUNK) + F.lit(CHUNK // 2) + F.col("_place"))
    each = each.select("_slot", "_slice", "_pos", "_row", F.when(F.col("id").isNull(), 0).otherwise(1).alias("_kind"), iteration, draw)
    each = each.withColumn("_pos", F.coalesce("_pos", hash_uniform(f"{spec.seed}-draw", "iteration", "draw")))
    merge = W.partitionBy("_slot", "_slice").orderBy("_pos", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = each.withColumn("_hit", F.last("_row", ignorenulls=True).over(merge)).filter("_kind = 1")
    spread = (F.col("_hit.age_max") - F.col("_hit.age")) / 2
    return met.select(
        "iteration", "draw",
        _jitter(
            F.col("_hit.age"), spread, hash_uniform(f"{spec.seed}-j1", "iteration", "draw"), hash_uniform(f"{spec.seed}-j2", "iteration", "draw")
        ).alias("age"),
        F.col("_hit.probability").alias("probability"),
    )


# means up to here follow the inverse of the Poisson law term by term
POISSON_INVERSE = 500.0


def poisson_draws(weighted: DataFrame, spec: SeriesSpec, most: int = 12) -> DataFrame:
    """The large-scale form: every row decides by itself how often it is drawn, Poisson(n * p_i) per iteration.

    No draw is shuffled. The copies of a row follow the Poisson inverse, summed until the uniform is reached. Rows are first dealt
    to as many tasks as the draws need: a small file or a small join gives them to very few.
    """
    weighted = cut_lineage(weighted.select(c(spec.row_id), c(spec.age), c(spec.age_max), c(spec.probability), "weight"))
    totals = weighted.agg(F.sum("weight").alias("w"), F.count("*").alias("n")).first()
    mean = F.lit(float(totals["n"])) * c("weight") / F.lit(totals["w"])
    tasks = max(3 * weighted.sparkSession.sparkContext.defaultParallelism, math.ceil(totals["n"] * spec.iterations / DRAWS_PER_TASK))
    rows = weighted.repartition(tasks, c(spec.row_id)).withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(spec.iterations - 1)))).withColumn("_m", mean)
    seed = spec.seed

    def copies(u: np.ndarray, m: np.ndarray) -> np.ndarray:
        count = np.zeros(len(u), dtype=np.int64)
        heavy = m > POISSON_INVERSE
        for i in np.flatnonzero(heavy):
            # exp(-m) is no number here; a generator keyed by the row's own uniform draws the exact law
            count[i] = np.random.default_rng(int(u[i] * 2**52)).poisson(m[i])
        light = np.flatnonzero(~heavy)
        if len(light):
            x, y = m[light], u[light]
            mass = np.exp(-x)
            below, k, found = mass.copy(), 0, np.zeros(len(light), dtype=np.int64)
            limit = int(x.max() + 12 * math.sqrt(x.max() + 1) + most)
            while k < limit and (y > below).any():
                found += y > below
                k += 1
                mass = mass * x / k
                below = below + mass
            count[light] = found
        return count

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def poisson(u, m):  # noqa: ANN001
        import pandas as pd

        return pd.Series(copies(u.to_numpy(), m.to_numpy()))

    counted = rows.withColumn("_n", poisson(hash_uniform(f"{seed}-poisson", "iteration", spec.row_id), "_m")).filter("_n > 0")
    each = counted.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    spread = (c(spec.age_max) - c(spec.age)) / 2
    return each.select(
        "iteration", "draw",
        _jitter(
            c(spec.age), spread, hash_uniform(f"{seed}-j1", "iteration", spec.row_id, "draw"),
            hash_uniform(f"{seed}-j2", "iteration", spec.row_id, "draw"),
        ).alias("age"),
        c(spec.probability).alias("probability"),
    )


def bin_shares(draws: DataFrame, bins: int, width: float) -> DataFrame:
    """100 * share of probability >= 0.5 per (iteration, bin). Bins are closed on both sides.

    A value on an inner edge counts in both bins; values outside [0, bins * width] are dropped. Rows without
    a probability only enlarge the denominator.
    """
    w = F.lit(float(width))
    b = F.floor(F.col("age") / w)
    on_edge = (b * w == F.col("age")) & (b > 0)
    slots = F.when(on_edge, F.array(b - 1, b)).otherwise(F.array(b))
    inside = draws.filter((F.col("age") >= 0) & (F.col("age") <= F.lit(bins * float(width))))
    return (
        inside.select("iteration", F.explode(slots).alias("bin"), F.coalesce((F.col("probability") >= 0.5).cast("int"), F.lit(0)).alias("hit"))
        .filter(F.col("bin") < bins)
        .groupBy("iteration", "bin").agg((F.sum("hit") / F.count("*") * 100).alias("share"))
    )


def series(shares: DataFrame, bins: int, width: float, unit: str = "Ma") -> DataFrame:
    """Mean and two population standard deviations over iterations; empty bins stay as NULL rows."""
    per_bin = shares.groupBy("bin").agg(F.avg("share").alias("mean"), (2 * F.stddev_pop("share")).alias("two_sigma"))
    grid = shares.sparkSession.range(bins).withColumnRenamed("id", "bin")
    scale = 1000.0 if unit == "Ga" else 1.0
    return grid.join(per_bin, "bin", "left").select(
        "bin", ((F.col("bin") + 0.5) * F.lit(float(width)) / scale).alias("age"), "mean", "two_sigma"
    )


def subaerial_series(df: DataFrame, spec: SeriesSpec, method: str = "draws", missing_probability: str = "error") -> DataFrame:
    """The whole run: check, weigh, draw, bin, summarise.

    ``missing_probability``: ``error``; ``drop`` removes such rows; ``denominator`` leaves them out of the
    resampling but counts their jittered age in every iteration.
    """
    df = nan_to_null(df)
    bins = validate(df, spec, missing_probability != "error")
    extra = None
    if missing_probability != "error":
        if missing_probability == "denominator":
            kept = df.filter(c(spec.probability).isNull())
            kept = kept.withColumn("iteration", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spec.iterations - 1).cast("long"))))
            spread = (c(spec.age_max) - c(spec.age)) / 2
            extra = kept.select(
                "iteration", F.lit(-1).cast("long").alias("draw"),
                _jitter(
                    c(spec.age), spread, hash_uniform(f"{spec.seed}-m1", "iteration", spec.row_id),
                    hash_uniform(f"{spec.seed}-m2", "iteration", spec.row_id),
                ).alias("age"),
                F.lit(None).cast("double").alias("probability"),
            )
        df = df.filter(c(spec.probability).isNotNull())
    weighted = sample_weights(df, spec)
    draws = bootstrap_draws(weighted, spec) if method == "draws" else poisson_draws(weighted, spec)
    if extra is not None:
        draws = draws.unionByName(extra)
    return series(bin_shares(draws, bins, spec.bin_width), bins, spec.bin_width)


def series_metrics(result: DataFrame) -> DataFrame:
    return result.agg(
        F.count("mean").alias("populated_bins"), F.count("*").alias("total_bins"), F.avg("mean").alias("mean_share")
    )
