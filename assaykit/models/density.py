"""Density clustering on positions: DBSCAN and mean shift."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.operators.all_pairs import counts_within, links_within, lowest_within
from assaykit.operators.graph import connected_components, number_in_order
from assaykit.operators.neighbors import BLOCK, BOX_DIMENSIONS, block_join, build_cells, distances, locations, sums_over
from assaykit.table import c, cut_lineage, features_array, written


def close_pairs(x: np.ndarray, y: np.ndarray, eps: float, p: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` lie within ``eps``."""
    return np.concatenate([distances(x[s : s + 256], y, p) <= eps for s in range(0, len(x), 256)])


def _spanning_pairs(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of a spanning forest of the pairs a table marks: what a block has to tell about its connections.

    Forests grow by whole frontiers; a row or column is looked at once, however many pairs it has.
    """
    rows, columns = close.any(axis=1), close.any(axis=0)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(len(close)):
        if not rows[start]:
            continue
        rows[start] = False
        front = np.array([start])
        while len(front):
            open_ = np.flatnonzero(columns)
            part = close[np.ix_(front, open_)]
            hit = part.any(axis=0)
            found = open_[hit]
            out.append((front[part[:, hit].argmax(axis=0)], found))
            columns[found] = False
            open_ = np.flatnonzero(rows)
            part = close[np.ix_(open_, found)]
            hit = part.any(axis=1)
            front = open_[hit]
            out.append((front, found[part[hit].argmax(axis=1)] if len(found) else found))
            rows[front] = False
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(side) for side in zip(*out))


def _grid(eps: float, d: int, p: float):
    """The grid cell of a position, so small that all its positions lie within ``eps`` of each other; null where numbers are too large for it."""
    side = eps / d ** (1.0 / p) * (1 - 1e-6)
    if not side > 0:
        return F.lit(None).cast("array<long>")
    fits = F.forall("_f", lambda v: F.abs(v) < F.lit(side * 2.0**31))
    return F.when(fits, F.transform("_f", lambda v: F.floor(v / F.lit(side)).cast("long")))


def _linked(core: DataFrame, eps: float, p: float, block: int) -> DataFrame:
    """(_f, _id): core positions with the smallest core row of their cluster.

    Two positions of every grid cell are linked first; then positions outside the largest part look for links that these missed:
    a link between two parts has an end outside it.
    """
    kind = dict(core.dtypes)["_id"]

    def connect(a, b, x, y):
        ids_a, ids_b = a["_id"].to_numpy(), b["_id"].to_numpy()
        i, j = _spanning_pairs(close_pairs(x, y, eps, p))
        found = pd.DataFrame({"a": ids_a[i], "b": ids_b[j]})
        return found[found["a"] != found["b"]].drop_duplicates()

    def links(asking: DataFrame, points: DataFrame) -> DataFrame:
        tagged, cells = build_cells(points, block, p)
        return block_join(asking.withColumn("_radius", F.lit(float(eps))), tagged, cells, connect, f"a {kind}, b {kind}", radius="_radius", p=p, block=block)

    one = F.struct(F.xxhash64("_f").alias("h"), F.col("_id"), F.col("_f"))
    ends = core.filter("_g is not null").groupBy("_g").agg(F.min(one).alias("s"), F.max(one).alias("t"))
    ends = cut_lineage(ends.select("_g", F.col("s._id").alias("_a"), F.col("s._f").alias("_x"), F.col("t._id").alias("_b"), F.col("t._f").alias("_y")))
    few = ends.select(F.col("_a").alias("_id"), F.col("_x").alias("_f")).unionByName(ends.filter("_a <> _b").select(F.col("_b").alias("_id"), F.col("_y").alias("_f")))
    few = cut_lineage(few.unionByName(core.filter("_g is null").select("_id", "_f")))
    own = ends.filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    parts = connected_components(links(few.select("_f", "_id"), few.select("_f", "_id")).unionByName(own))
    heads = core.join(ends.select("_g", "_a"), "_g", "left").select("_f", "_id", F.coalesce("_a", "_id").alias("_a"))
    named = heads.join(parts, F.col("_a") == F.col("node"), "left").select("_f", "_id", F.coalesce("component", "_a").alias("_c"))
    named = cut_lineage(named)
    if named.count() > few.count():
        largest = named.groupBy("_c").count().orderBy(F.desc("count"), "_c").first()["_c"]
        points = named.select("_f", F.col("_c").alias("_id"))
        asking = points.filter(F.col("_id") != largest)
        if not asking.isEmpty():
            more = connected_components(links(asking, points))
            named = cut_lineage(named.join(more, F.col("_c") == F.col("node"), "left").select("_f", "_id", F.coalesce("component", "_c").alias("_c")))
    least = named.groupBy("_c").agg(F.min("_id").alias("_l"))
    return named.join(least, "_c").select("_f", F.col("_l").alias("_id"))


def _clusters_by_blocks(spots: DataFrame, eps: float, min_samples: int, width: int, size: int) -> DataFrame:
    """(_f, cluster, near): for ``spots(_f, _id, _n, _cell)`` the cluster of each core position and the lowest cluster near each other one.

    For many coordinates, where cells rule out little. A position asks until it has ``min_samples`` rows, or one link to another part; then parts
    outside the largest look for links to others, until none has any: a link between two parts has an end outside the largest.
    """
    spots = written(number_in_order(spots, "_id", ["_f", "_n", "_cell"]))
    counted = counts_within(spots, eps, min_samples, width, size)
    core = written(counted.filter(F.col("total") >= min_samples).select("_no", F.col("_no").alias("comp"), F.lit(True).alias("open")))
    cores, places = core.count(), spots.select("_f", "_no", "_cell")
    asked, parts, last = cores, core, None
    while asked:
        nodes = written(places.join(parts, "_no"))
        asking = nodes.filter(F.col("open") & (F.col("comp") != F.lit(-1 if last is None else last)))
        found = connected_components(links_within(asking, nodes, eps, width, asked, cores))
        parts = parts.join(found, F.col("comp") == F.col("node"), "left")
        # a part without a link is whole
        parts = written(parts.select("_no", F.coalesce("component", "comp").alias("comp"), F.col("component").isNotNull().alias("open")))
        last = parts.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()["comp"]
        asked = parts.filter(F.col("open") & (F.col("comp") != last)).count()
    heads = parts.groupBy("comp").agg(F.min("_no").alias("_l"))
    numbers = number_in_order(heads, "_l", ["comp"]).select("comp", F.col("_no").alias("cluster"))
    labelled = written(parts.join(numbers, "comp").select("_no", "cluster"))
    outside = written(places.join(labelled, "_no", "left_anti"))
    asked = outside.count()
    out = places.join(labelled, "_no", "left")
    if not asked or not cores:
        return out.select("_f", "cluster", F.lit(None).cast("long").alias("near"))
    near = lowest_within(outside, places.join(labelled, "_no"), eps, width, asked, cores)
    return out.join(near, "_no", "left").select("_f", "cluster", "near")


def dbscan(
    df: DataFrame, features: Sequence[str], row_id: str, eps: float = 0.5, min_samples: int = 5, p: float = 2.0,
    block: int = BLOCK,
) -> DataFrame:
    """(row id, cluster, is_core). Clusters are numbered by their smallest core row; noise is -1.

    A border row joins the lowest-numbered cluster that has a core row within eps. Positions of one grid cell need no
    comparing, and blocks report a spanning forest of their core connections, not every close pair. In many coordinates blocks
    meet where they are stored, and positions ask for as many others as they need. A row with a feature that is missing or infinite is noise.
    """
    keyed = df.select(features_array(features).alias("_f"), c(row_id).alias("_id"))
    spots = keyed.filter(F.forall("_f", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    spots = spots.groupBy("_f").agg(F.count("*").alias("_n"), F.min("_id").alias("_id"))
    spots = cut_lineage(spots)
    tagged, cells = build_cells(spots, block, p)
    if p == 2 and len(features) > BOX_DIMENSIONS and len(cells.size) > 1:
        found = written(_clusters_by_blocks(tagged, float(eps), min_samples, len(features), int(cells.size.sum())))
        out = keyed.join(found, "_f", "left")
        return out.select(
            F.col("_id").alias(row_id), F.coalesce("cluster", "near", F.lit(-1)).cast("long").alias("cluster"),
            F.col("cluster").isNotNull().alias("is_core"),
        )
    # all rows of a thick grid cell lie within eps of each other, so only the others have to be counted
    gridded = cut_lineage(spots.withColumn("_g", _grid(eps, len(features), p)))
    thick = gridded.filter("_g is not null").groupBy("_g").agg(F.sum("_n").alias("_m")).filter(F.col("_m") >= min_samples).select("_g")
    thin = gridded.join(thick, "_g", "left_anti")
    reach = sums_over(thin.select("_f"), tagged, cells, np.ones_like, radius=eps, p=p, block=block)
    counted = thin.join(reach, "_f").filter(F.col("total") >= min_samples).select("_f", "_id", "_g")
    core = gridded.join(thick, "_g", "left_semi").select("_f", "_id", "_g").unionByName(counted)
    core = cut_lineage(core)
    if core.isEmpty():
        return keyed.select(F.col("_id").alias(row_id), F.lit(-1).cast("long").alias("cluster"), F.lit(False).alias("is_core"))
    named = _linked(core, eps, p, block).withColumnRenamed("_id", "_c")
    named = cut_lineage(named)
    heads = named.select("_c").distinct()
    numbers = number_in_order(heads, "_c")
    labelled = cut_lineage(named.join(numbers, "_c").select("_f", F.col("_no").alias("cluster")))
    touched, touched_cells = build_cells(labelled.withColumn("_n", F.lit(1)), block, p)

    def lowest(a, b, x, y):
        label = b["cluster"].to_numpy().astype(float)
        low = np.concatenate([
            np.where(distances(x[s : s + 256], y, p) <= eps, label[None, :], np.inf).min(axis=1) for s in range(0, len(x), 256)
        ])
        hit = np.isfinite(low)
        return pd.DataFrame({"_f": a["_f"].to_numpy()[hit], "near": low[hit].astype(np.int64)})

    outside = spots.join(named.select("_f"), "_f", "left_anti").select("_f").withColumn("_radius", F.lit(float(eps)))
    border = block_join(outside, touched, touched_cells, lowest, "_f array<double>, near long", radius="_radius", p=p, block=block)
    border = border.groupBy("_f").agg(F.min("near").alias("near"))
    out = keyed.join(labelled, "_f", "left").join(border, "_f", "left")
    return out.select(
        F.col("_id").alias(row_id), F.coalesce("cluster", "near", F.lit(-1)).cast("long").alias("cluster"),
        F.col("cluster").isNotNull().alias("is_core"),
    )


def mean_shift(
    df: DataFrame, features: Sequence[str], row_id: str, bandwidth: float, bin_seeding: bool = True, min_bin_freq: int = 1,
    cluster_all: bool = True, max_iter: int = 300, block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(row labels, centres). Flat kernel: each seed moves to the mean of the rows within the bandwidth.

    Seeds are grid cells (or positions); each round is one radius join of seeds and positions.
    """
    d = len(features)
    spots = cut_lineage(locations(df, features))
    tagged, cells = build_cells(spots, block)
    if bin_seeding:
        cell = F.array(*[F.round(F.col("_f")[j] / bandwidth) for j in range(d)])
        seeds = spots.groupBy(cell.alias("_g")).agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= min_bin_freq)
        seeds = seeds.select(F.transform("_g", lambda v: v * F.lit(float(bandwidth)) + 0.0).alias("_f"))
    else:
        seeds = spots.select("_f")
    active = cut_lineage(seeds.distinct())
    done = None
    stop = 1e-3 * bandwidth
    for step in range(max_iter):
        moved = sums_over(active, tagged, cells, np.ones_like, radius=bandwidth, coordinates=True, block=block).filter("total > 0")
        mean = F.array(*[F.col(f"_s{j}") / F.col("total") for j in range(d)])
        moved = moved.select("_f", mean.alias("_to"), "total")
        shift = F.sqrt(F.aggregate(F.zip_with("_f", "_to", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
        moved = cut_lineage(moved.withColumn("_shift", shift))
        settled = moved.filter((F.col("_shift") <= stop) | F.lit(step == max_iter - 1)).select(F.col("_to").alias("_f"), "total")
        done = settled if done is None else done.unionByName(settled)
        active = moved.filter(F.col("_shift") > stop).select(F.col("_to").alias("_f")).distinct()
        if active.isEmpty():
            break
    peaks = cut_lineage(done.groupBy("_f").agg(F.max("total").alias("weight")))
    centres = merge_peaks(peaks, bandwidth)
    return assign_to_centres(df, features, row_id, centres, None if cluster_all else bandwidth), centres


def merge_peaks(peaks: DataFrame, bandwidth: float, limit: int = 20_000) -> DataFrame:
    """Keep a peak when no heavier kept peak lies within the bandwidth; the number of peaks is checked."""
    rows = peaks.select(F.transform("_f", lambda v: F.round(v, 9)).alias("_f"), "weight").groupBy("_f").agg(
        F.max("weight").alias("weight")
    ).orderBy(F.desc("weight"), F.desc("_f")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} peaks: choose a larger bandwidth or min_bin_freq")
    x = np.array([r["_f"] for r in rows])
    kept: list[int] = []
    for i in range(len(x)):
        if not kept or distances(x[i : i + 1], x[kept]).min() > bandwidth:
            kept.append(i)
    out = [(k, [float(v) for v in x[i]], float(rows[i]["weight"])) for k, i in enumerate(kept)]
    return peaks.sparkSession.createDataFrame(out, "cluster long, _f array<double>, weight double")


def assign_to_centres(df: DataFrame, features: Sequence[str], row_id: str, centres: DataFrame, radius: float | None) -> DataFrame:
    """Label of the nearest centre (a bounded table); beyond ``radius`` the label is -1."""
    table = centres.orderBy("cluster").collect()
    y = np.array([r["_f"] for r in table])
    label = np.array([r["cluster"] for r in table])
    base = df.select(c(row_id).alias(row_id), features_array(features).alias("_f"))
    kind = dict(base.dtypes)[row_id]

    def nearest(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            d = distances(np.stack(pdf["_f"].to_numpy()), y)
            best = d.argmin(axis=1)
            found = label[best]
            if radius is not None:
                found = np.where(d[np.arange(len(d)), best] <= radius, found, -1)
            yield pd.DataFrame({row_id: pdf[row_id], "cluster": found})

    return base.mapInPandas(nearest, f"`{row_id}` {kind}, cluster long")
