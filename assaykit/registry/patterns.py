"""Queries over clustering, decomposition, anomaly detection and explanation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.models import cluster, decompose, linear
from assaykit.models.hierarchy import density_tree
from assaykit.models.isolation import isolation_forest
from assaykit.operators import columns, evaluate, explain
from assaykit.operators.sums import balanced
from assaykit.registry.core import BINARY_FEATURES, SAMPLES_SQL, dims, query, rounded, samples, vectors, vectors_sql
from assaykit.registry.distance import CUT_EPS, CUT_SQL, DBSCAN_SQL, EPS, MIN_SAMPLES, _knn_sql
from assaykit.registry.linear import scaled_binary


@query("k1_kmeans")
def kmeans(spark, sf):
    t = vectors(spark, sf, 64)
    model = cluster.kmeans(t, dims(64), 8, row_id="vec_id")
    return model.transform(t).select("vec_id", "cluster")


@query("k2_silhouette_by_k")
def by_k(spark, sf):
    return rounded(cluster.silhouette_by_k(vectors(spark, sf, 64), dims(64), "vec_id"), 3)


@query("k4_agglomerative")
def agglomerative(spark, sf):
    t = vectors(spark, sf, 64)
    out = None
    for linkage in ("ward", "complete", "average", "single"):
        one = cluster.agglomerative(t, dims(64), "vec_id", 4, linkage).withColumn("linkage", F.lit(linkage))
        out = one if out is None else out.unionByName(one)
    return out


@query("k5_affinity_propagation")
def affinity(spark, sf):
    return cluster.affinity_propagation(vectors(spark, sf, 64), dims(64), "vec_id", damping=0.7)


@query("k7_optics", f"WITH RECURSIVE {vectors_sql(4)}, {DBSCAN_SQL}, {_knn_sql(4, MIN_SAMPLES - 1)}, reach_of AS (SELECT vec_id, max(distance) AS d FROM edges GROUP BY 1) SELECT flat.*, round(d, 6) + 0.0 AS core_distance FROM flat JOIN reach_of USING (vec_id)")
def optics(spark, sf):
    return rounded(cluster.optics(vectors(spark, sf, 4), dims(4), "vec_id", MIN_SAMPLES, EPS))


@query("k7_density_cut", f"WITH RECURSIVE {vectors_sql(64)}, {CUT_SQL} SELECT * FROM flat")
def density_cut(spark, sf):
    """All coordinates; the tree of mutual reachability is cut at one eps."""
    return density_tree(vectors(spark, sf, 64), dims(64), "vec_id", MIN_SAMPLES).cut(CUT_EPS)


@query("k8_cluster_centres", f"WITH {vectors_sql(64)} SELECT label AS cluster, count(*) AS n, {', '.join(f'round(avg(x{i}), 8) + 0.0 AS x{i}' for i in range(64))} FROM vectors GROUP BY 1")
def centres(spark, sf):
    t = vectors(spark, sf, 64).withColumnRenamed("label", "cluster")
    return rounded(cluster.cluster_centres(t, dims(64)), 8)


PCA_SQL = f"""WITH {vectors_sql(2)}, m AS (SELECT avg(x0) AS m0, avg(x1) AS m1, var_samp(x0) AS a, covar_samp(x0, x1) AS b, var_samp(x1) AS d FROM vectors),
 e AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS l1, (a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b) AS l2 FROM m),
 v AS (SELECT *, b / sqrt(b * b + pow(l1 - a, 2)) AS u0, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS u1 FROM e),
 s AS (SELECT *, CASE WHEN abs(u0) >= abs(u1) THEN sign(u0) ELSE sign(u1) END AS f1, CASE WHEN abs(u1) >= abs(u0) THEN sign(u1) ELSE -sign(u0) END AS f2 FROM v)"""


@query("d1_pca_loadings", PCA_SQL + " SELECT 'x0' AS feature, 1 AS component, round(f1 * u0, 6) + 0.0 AS loading, round(l1 / (l1 + l2), 6) + 0.0 AS explained_ratio FROM s UNION ALL SELECT 'x1', 1, round(f1 * u1, 6) + 0.0, round(l1 / (l1 + l2), 6) + 0.0 FROM s UNION ALL SELECT 'x0', 2, round(f2 * u1, 6) + 0.0, round(l2 / (l1 + l2), 6) + 0.0 FROM s UNION ALL SELECT 'x1', 2, round(-f2 * u0, 6) + 0.0, round(l2 / (l1 + l2), 6) + 0.0 FROM s")
def pca_loadings(spark, sf):
    return rounded(decompose.pca(vectors(spark, sf, 2), dims(2), 2).loadings(spark))


@query("d1_pca_scores", PCA_SQL + ' SELECT vec_id, round((x0 - m0) * f1 * u0 + (x1 - m1) * f1 * u1, 6) + 0.0 AS "PC1", round((x0 - m0) * f2 * u1 - (x1 - m1) * f2 * u0, 6) + 0.0 AS "PC2" FROM vectors, s')
def pca_scores(spark, sf):
    t = vectors(spark, sf, 2)
    return rounded(decompose.pca(t, dims(2), 2).transform(t).select("vec_id", "PC1", "PC2"))


@query("d2_biplot", PCA_SQL + ', p AS (SELECT vec_id, (x0 - m0) * f1 * u0 + (x1 - m1) * f1 * u1 AS p1, (x0 - m0) * f2 * u1 - (x1 - m1) * f2 * u0 AS p2 FROM vectors, s), r AS (SELECT max(p1) - min(p1) AS r1, max(p2) - min(p2) AS r2 FROM p) SELECT vec_id, round(p1 / r1, 6) + 0.0 AS "PC1", round(p2 / r2, 6) + 0.0 AS "PC2" FROM p, r')
def biplot(spark, sf):
    t = vectors(spark, sf, 2)
    return rounded(decompose.biplot(decompose.pca(t, dims(2), 2), t, "vec_id"))


@query("d3_landmark_mds")
def mds(spark, sf):
    return rounded(decompose.landmark_mds(vectors(spark, sf, 64), dims(64), "vec_id", landmarks=300)[0], 4)


@query("d4_landmark_tsne")
def tsne(spark, sf):
    return rounded(decompose.landmark_tsne(vectors(spark, sf, 64), dims(64), "vec_id", landmarks=300), 1)


@query("o1_isolation_forest")
def iforest(spark, sf):
    t = balanced(samples(spark, sf).select("row_id", "quantity", "price", "full_tax"))
    model = isolation_forest(t, ["quantity", "price", "full_tax"], "row_id", trees=100, contamination=0.05)
    return rounded(model.transform(t).select("row_id", "anomaly_score", "is_abnormal"), 5)


@query("o3_result_tables")
def result_tables(spark, sf):
    t = vectors(spark, sf, 64)
    labelled = isolation_forest(t, dims(64), "vec_id", trees=100, contamination=0.1).transform(t)
    out = None
    for name, part in zip(("all", "normal", "abnormal"), columns.flag_abnormal(labelled)):
        one = part.select("vec_id", "is_abnormal").withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("e11_decision_regions")
def regions(spark, sf):
    t = scaled_binary(spark, sf)
    model = linear.sgd_classification(t, ["n_chars", "n_lines"], "quality", (0, 1), "log_loss")
    out = explain.decision_regions(t, "n_chars", "n_lines", model.transform)
    return rounded(out.select("id", "n_chars", "n_lines", "prediction"), 4)


@query("e12_permutation_importance")
def permutation(spark, sf):
    t = samples(spark, sf).select("row_id", "quantity", "full_tax", "price")
    model = linear.linear_regression(t, ["quantity", "full_tax"], "price")
    drops = explain.permutation_importance(
        t, ["quantity", "full_tax"], "row_id", model.transform, lambda p: evaluate.regression_scores(p, "price", "prediction"), "r2", repeats=10
    )
    return rounded(explain.importance_summary(drops), 4)


@query("e19_cell_table", f"WITH {SAMPLES_SQL}, b AS (SELECT min(quantity) AS x0, (max(quantity) - min(quantity)) / 20 AS dx, min(price) AS y0, (max(price) - min(price)) / 20 AS dy FROM samples) SELECT least(floor((quantity - x0) / dx), 19)::BIGINT AS i, least(floor((price - y0) / dy), 19)::BIGINT AS j, count(*) AS n, round(avg(full_tax), 11) + 0.0 AS mean_value FROM samples, b GROUP BY 1, 2")
def cells(spark, sf):
    return rounded(explain.cell_table(samples(spark, sf), "quantity", "price", 20, "full_tax"), 11)


@query("e19_scatter_table", f"WITH {vectors_sql(3)} SELECT vec_id, x0, x2, label FROM vectors")
def scatter(spark, sf):
    return explain.scatter_table(vectors(spark, sf, 3), "vec_id", ["x0", "x2"], "label")
