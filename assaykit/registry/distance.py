"""Queries over distances: neighbours, outlier factor, density clusters, silhouettes, age series."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.models.density import dbscan, mean_shift
from assaykit.models.knn import knn_classification, knn_regression, local_outlier_factor
from assaykit.operators import evaluate
from assaykit.operators.neighbors import build_cells, cells_visited, euclidean_silhouette, locations, nearest_neighbors, sums_over
from assaykit.operators.split import random_split
from assaykit.plans import timeseries as ts
from assaykit.registry.core import GEO_SQL, dims, geo, query, rounded, vectors, vectors_sql
from assaykit.table import hash_uniform_sql


def _d2(n: int, a: str = "a", b: str = "b") -> str:
    return " + ".join(f"({a}.x{i} - {b}.x{i}) * ({a}.x{i} - {b}.x{i})" for i in range(n))


def _knn_sql(n: int, k: int, left: str = "vectors", right: str = "vectors", skip_self: bool = True) -> str:
    cond = "a.vec_id <> b.vec_id" if skip_self else "TRUE"
    return f"""edges AS (SELECT * FROM (SELECT a.vec_id, b.vec_id AS neighbor, sqrt({_d2(n)}) AS distance, b.label AS nlabel, b.x0 AS nx0,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {_d2(n)}, b.vec_id) AS rank FROM {left} a JOIN {right} b ON {cond}) WHERE rank <= {k})"""


@query("j4_distance_sums", f"WITH {vectors_sql(64)} SELECT a.vec_id, round(sum(1 / (1 + {_d2(64)})), 6) + 0.0 AS total FROM vectors a, vectors b GROUP BY 1")
def distance_sums(spark, sf):
    t = vectors(spark, sf, 64)
    spots = locations(t, dims(64))
    tagged, cells = build_cells(spots)
    sums = sums_over(spots.select("_f"), tagged, cells, lambda d: 1.0 / (1.0 + d * d))
    keyed = t.select("vec_id", F.array(*dims(64)).alias("_f")).join(sums, "_f")
    return rounded(keyed.select("vec_id", "total"))


@query("j5_nearest_neighbors", f"WITH {vectors_sql(64)}, {_knn_sql(64, 5)} SELECT vec_id, neighbor, round(distance, 6) + 0.0 AS distance, rank FROM edges")
def neighbours(spark, sf):
    t = vectors(spark, sf, 64)
    return rounded(nearest_neighbors(t, t, dims(64), 5, "vec_id", "vec_id", exclude_self=True))


@query("j5_cells_visited")
def visited(spark, sf):
    """How many cells a search by place visits for each sample."""
    t = geo(spark, sf)
    return cells_visited(t, t, ["latitude", "longitude"], 2.0, "row_id", block=64)


def _split_sql(n: int) -> str:
    u = hash_uniform_sql(42, "vec_id")
    return f"train AS (SELECT * FROM vectors WHERE {u} >= 0.2), test AS (SELECT * FROM vectors WHERE {u} < 0.2)"


def _train_test(spark, sf, n):
    t = random_split(vectors(spark, sf, n), "vec_id", 0.2)
    return t.filter("split = 'train'"), t.filter("split = 'test'")


@query("r8_knn_regression", f"WITH {vectors_sql(64)}, {_split_sql(64)}, {_knn_sql(64, 5, 'test', 'train', False)} SELECT vec_id, round(sum(nlabel / distance) / sum(1 / distance), 6) + 0.0 AS prediction FROM edges GROUP BY 1")
def knn_reg(spark, sf):
    train, test = _train_test(spark, sf, 64)
    return rounded(knn_regression(train, test, dims(64), "label", "vec_id", 5, weights="distance"))


@query("c10_knn_classification", f"WITH {vectors_sql(64)}, {_split_sql(64)}, {_knn_sql(64, 7, 'test', 'train', False)}, v AS (SELECT vec_id, nlabel, count(*) AS n FROM edges GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, nlabel) AS p FROM v) SELECT vec_id, nlabel AS prediction, round(n / 7.0, 6) + 0.0 AS probability FROM r WHERE p = 1")
def knn_cls(spark, sf):
    train, test = _train_test(spark, sf, 64)
    return rounded(knn_classification(train, test, dims(64), "label", "vec_id", 7))


LOF_SQL = f"""WITH {vectors_sql(64)}, {_knn_sql(64, 20)}, kd AS (SELECT vec_id, max(distance) AS kd FROM edges GROUP BY 1),
 lrd AS (SELECT e.vec_id, 1 / (avg(greatest(distance, kd.kd)) + 1e-10) AS lrd FROM edges e JOIN kd ON e.neighbor = kd.vec_id GROUP BY 1),
 lof AS (SELECT e.vec_id, avg(l.lrd) / any_value(o.lrd) AS lof FROM edges e JOIN lrd l ON e.neighbor = l.vec_id JOIN lrd o ON e.vec_id = o.vec_id GROUP BY 1)
 SELECT vec_id, round(lof, 6) + 0.0 AS lof, round(-lof, 6) + 0.0 AS negative_outlier_factor, CASE WHEN lof > (SELECT quantile_cont(lof, 0.9) FROM lof) THEN -1 ELSE 1 END::BIGINT AS is_abnormal FROM lof"""


@query("o2_local_outlier_factor", LOF_SQL)
def lof(spark, sf):
    return rounded(local_outlier_factor(vectors(spark, sf, 64), dims(64), "vec_id", 20, contamination=0.1))


EPS, MIN_SAMPLES = 0.12, 6


DBSCAN_SQL = f"""near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON sqrt({_d2(4)}) <= {EPS}),
 core AS (SELECT a AS vec_id FROM near GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
 link AS (SELECT a, b FROM near WHERE a IN (SELECT vec_id FROM core) AND b IN (SELECT vec_id FROM core)),
 reach(a, b) AS (SELECT vec_id, vec_id FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
 comp AS (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a),
 num AS (SELECT vec_id, dense_rank() OVER (ORDER BY c) - 1 AS cluster FROM comp),
 border AS (SELECT n.a AS vec_id, min(num.cluster) AS cluster FROM near n JOIN num ON n.b = num.vec_id WHERE n.a NOT IN (SELECT vec_id FROM core) GROUP BY 1),
 flat AS (SELECT v.vec_id, coalesce(num.cluster, border.cluster, -1)::BIGINT AS cluster, num.cluster IS NOT NULL AS is_core FROM vectors v LEFT JOIN num USING (vec_id) LEFT JOIN border ON border.vec_id = v.vec_id)"""


# rows lie farther apart in all coordinates than in four of them
CUT_EPS = 1.17
CUT_SQL = DBSCAN_SQL.replace(_d2(4), _d2(64)).replace(f"<= {EPS})", f"<= {CUT_EPS})")


@query("k3_dbscan", f"WITH RECURSIVE {vectors_sql(64)}, {CUT_SQL} SELECT * FROM flat")
def density_clusters(spark, sf):
    return dbscan(vectors(spark, sf, 64), dims(64), "vec_id", CUT_EPS, MIN_SAMPLES)


@query("k6_mean_shift")
def shift(spark, sf):
    labels, _ = mean_shift(vectors(spark, sf, 4), dims(4), "vec_id", 0.25, bin_seeding=True, max_iter=30)
    return labels


@query("e17_silhouette", f"""WITH {vectors_sql(64)}, s AS (SELECT a.vec_id, a.label, b.label AS other, sum(sqrt({_d2(64)})) AS total, count(*) AS n FROM vectors a, vectors b GROUP BY 1, 2, 3),
 p AS (SELECT vec_id, label, max(CASE WHEN label = other THEN total / nullif(n - 1, 0) END) AS a, max(CASE WHEN label = other THEN n END) AS n, min(CASE WHEN label <> other THEN total / n END) AS b FROM s GROUP BY 1, 2)
 SELECT vec_id, label, round(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS silhouette FROM p""")
def silhouette(spark, sf):
    return rounded(euclidean_silhouette(vectors(spark, sf, 64), dims(64), "label", "vec_id"))


@query("e17_silhouette_squared", f"""WITH {vectors_sql(64)}, s AS (SELECT a.vec_id, a.label, b.label AS other, sum({_d2(64)}) AS total, count(*) AS n FROM vectors a, vectors b GROUP BY 1, 2, 3),
 p AS (SELECT vec_id, label, max(CASE WHEN label = other THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN label <> other THEN total / n END) AS b FROM s GROUP BY 1, 2)
 SELECT vec_id, label, round(coalesce((b - a) / greatest(a, b), 0), 6) + 0.0 AS silhouette FROM p""")
def silhouette_sq(spark, sf):
    return rounded(evaluate.squared_silhouette(vectors(spark, sf, 64), dims(64), "label", "vec_id"))


@query("e18_calinski_harabasz", f"WITH {vectors_sql(64)}, g AS (SELECT label, count(*) AS n, {', '.join(f'avg(x{i}) AS m{i}, var_pop(x{i}) AS v{i}' for i in range(64))} FROM vectors GROUP BY 1), t AS (SELECT {', '.join(f'avg(x{i}) AS t{i}' for i in range(64))} FROM vectors) SELECT count(*) AS k, sum(n)::BIGINT AS n, round((sum({' + '.join(f'n * (m{i} - t{i}) * (m{i} - t{i})' for i in range(64))}) / (count(*) - 1)) / (sum({' + '.join(f'n * v{i}' for i in range(64))}) / (sum(n) - count(*))), 6) + 0.0 AS calinski_harabasz FROM g, t")
def calinski(spark, sf):
    return rounded(evaluate.calinski_harabasz(vectors(spark, sf, 64), dims(64), "label"))


# ---------------------------------------------------------------- age series
SPEC = ts.SeriesSpec(bin_width=50.0, iterations=100, seed=42)
WEIGHT_SQL = f"""{GEO_SQL}, kern AS (SELECT a.row_id, sum(1 / (pow((b.latitude - a.latitude) / 2, 2) + pow((b.longitude - a.longitude) / 2, 2) + 1) + 1 / (pow((b.age - a.age) / 38, 2) + 1)) AS s FROM geo a, geo b GROUP BY 1),
 weighted AS (SELECT g.*, 0.2 / s AS weight FROM geo g JOIN kern USING (row_id))"""
DRAW_SQL = f"""{WEIGHT_SQL}, pos AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY {hash_uniform_sql(42, 'row_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT sum(weight) FROM weighted) AS lo FROM weighted),
 draws AS (SELECT i AS iteration, j AS draw, {hash_uniform_sql('42-draw', 'i', 'j')} AS u FROM range(100) r(i), range((SELECT count(*) FROM geo)) s(j)),
 hits AS (SELECT iteration, draw, p.age + (p.age_max - p.age) / 2 * sqrt(-2 * ln(1 - {hash_uniform_sql('42-j1', 'iteration', 'draw')})) * cos(2 * pi() * {hash_uniform_sql('42-j2', 'iteration', 'draw')}) AS age, p.probability FROM draws d ASOF JOIN pos p ON d.u >= p.lo)"""
SHARE_SQL = f"""{DRAW_SQL}, nb AS (SELECT ceil(max(age_max) / 50) AS bins FROM geo), shares AS (SELECT iteration, bin, sum(CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END) / count(*) * 100 AS share
 FROM hits, nb, range(1000) b(bin) WHERE bin < bins AND age >= bin * 50 AND age <= (bin + 1) * 50 GROUP BY 1, 2)"""


@query("t6_series_bins", f"WITH {GEO_SQL} SELECT count(*) AS n, ceil(max(age_max) / 50)::BIGINT AS bins FROM geo")
def series_bins(spark, sf):
    t = geo(spark, sf)
    return t.agg(F.count("*").alias("n"), F.lit(ts.validate(t, SPEC)).cast("long").alias("bins"))


@query("t7_sample_weights", f"WITH {WEIGHT_SQL} SELECT row_id, round(1000 * weight, 8) + 0.0 AS weight FROM weighted")
def weights(spark, sf):
    w = ts.sample_weights(geo(spark, sf), SPEC)
    return rounded(w.select("row_id", (1000 * F.col("weight")).alias("weight")), 8)


@query("t8_bootstrap_draws", f"WITH {DRAW_SQL} SELECT iteration, draw, round(age, 5) + 0.0 AS age, round(probability, 6) + 0.0 AS probability FROM hits")
def draws(spark, sf):
    return rounded(ts.bootstrap_draws(ts.sample_weights(geo(spark, sf), SPEC), SPEC), {"age": 5})


@query("t9_bin_shares", f"WITH {SHARE_SQL} SELECT iteration, bin, round(share, 6) + 0.0 AS share FROM shares")
def shares(spark, sf):
    t = geo(spark, sf)
    bins = ts.validate(t, SPEC)
    return rounded(ts.bin_shares(ts.bootstrap_draws(ts.sample_weights(t, SPEC), SPEC), bins, 50.0))


SERIES_SQL = f"{SHARE_SQL}, series AS (SELECT bin, round((bin + 0.5) * 50, 6) + 0.0 AS age, round(avg(share), 6) + 0.0 AS mean, round(2 * stddev_pop(share), 6) + 0.0 AS two_sigma FROM (SELECT bin FROM range(1000) b(bin), nb WHERE bin < bins) LEFT JOIN shares USING (bin) GROUP BY bin)"


@query("t10_age_series", f"WITH {SERIES_SQL} SELECT * FROM series")
def age_series(spark, sf):
    return rounded(ts.subaerial_series(geo(spark, sf), SPEC))


@query("t11_series_metrics", f"WITH {SERIES_SQL} SELECT count(mean) AS populated_bins, count(*) AS total_bins, round(avg(mean), 5) + 0.0 AS mean_share FROM series")
def metrics(spark, sf):
    return rounded(ts.series_metrics(ts.subaerial_series(geo(spark, sf), SPEC)), 5)


# rows without a probability draw nothing; their jittered age counts in the denominator of every iteration
T12_SQL = SHARE_SQL.replace("FROM geo a, geo b GROUP BY 1)", "FROM known a, known b GROUP BY 1)").replace("FROM geo g JOIN kern", "FROM known g JOIN kern") \
    .replace(", kern AS", ", known AS (SELECT * FROM geo WHERE probability <= 0.9), kern AS").replace("range((SELECT count(*) FROM geo))", "range((SELECT count(*) FROM known))") \
    .replace(", nb AS", f""", late AS (SELECT i AS iteration, -1 AS draw, age + (age_max - age) / 2 * sqrt(-2 * ln(1 - {hash_uniform_sql('42-m1', 'i', 'row_id')})) * cos(2 * pi() * {hash_uniform_sql('42-m2', 'i', 'row_id')}) AS age, NULL AS probability
 FROM geo, range(100) r(i) WHERE probability > 0.9), every AS (SELECT * FROM hits UNION ALL SELECT * FROM late), nb AS""").replace("FROM hits, nb", "FROM every, nb")


@query("t12_missing_probability", f"WITH {SERIES_SQL.replace(SHARE_SQL, T12_SQL)} SELECT * FROM series")
def missing_probability(spark, sf):
    t = geo(spark, sf).withColumn("probability", F.when(F.col("probability") <= 0.9, F.col("probability")))
    return rounded(ts.subaerial_series(t, SPEC, missing_probability="denominator"))


@query("t8_poisson_series")
def poisson_series(spark, sf):
    return rounded(ts.subaerial_series(geo(spark, sf), SPEC, method="poisson"))
