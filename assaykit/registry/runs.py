"""Queries over model persistence, search, all-model runs and scoring of new tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from assaykit.models import linear
from assaykit.operators.split import random_split
from assaykit.operators.sums import balanced
from assaykit.plans.models import MENU, score_table
from assaykit.plans.patterns import PatternRun
from assaykit.plans.preparation import Preparation
from assaykit.plans.search import draw_settings, library_search, run_all, search
from assaykit.plans.workflow import Workflow
from assaykit.registry.core import SAMPLES_SQL, dims, query, rounded, samples, vectors, vectors_sql
from assaykit.registry.distance import DBSCAN_SQL, EPS, LOF_SQL, MIN_SAMPLES, _knn_sql, _split_sql
from assaykit.registry.patterns import PCA_SQL
from assaykit.sources import sinks, tracking
from assaykit.streaming.scoring import read_stream, score_stream
from assaykit.table import TableSpec, hash_uniform, hash_uniform_sql, read_table, scratch_path

APP_SQL = f"""{SAMPLES_SQL}, a AS (SELECT *, {hash_uniform_sql('app', 'row_id')} >= 0.9 AS app FROM samples), g AS (SELECT regr_slope(price, quantity) AS a, regr_intercept(price, quantity) AS b FROM a WHERE NOT app)"""

APP_SPLIT_SQL = f"WITH {SAMPLES_SQL}, s AS (SELECT *, {hash_uniform_sql(42, 'row_id')} < 0.2 AS test FROM samples)"


def _fit_app(spark, sf):
    t = samples(spark, sf).withColumn("app", hash_uniform("app", "row_id") >= 0.9)
    train, app = t.filter("not app"), t.filter("app").drop("price")
    train = balanced(train.select("quantity", "price")).persist()
    prep = Preparation(("quantity",), ("price",), scale="standardize").fit(train)
    model = linear.linear_regression(prep.transform(train), prep.features, "price")
    train.unpersist()
    return prep, model, app


@query("io8_model_round_trip", f"WITH {SAMPLES_SQL} SELECT row_id, round(regr_slope(price, quantity) OVER () * quantity + regr_intercept(price, quantity) OVER (), 3) + 0.0 AS prediction FROM samples")
def round_trip(spark, sf):
    t = samples(spark, sf)
    stages = [VectorAssembler(inputCols=["quantity"], outputCol="v"), LinearRegression(featuresCol="v", labelCol="price", solver="normal")]
    path = sinks.save_model(Pipeline(stages=stages).fit(t), scratch_path(spark, "model"))
    return rounded(sinks.load_model(path).transform(t).select("row_id", "prediction"), 3)


@query("io10_leaderboard_summary", "SELECT count(*) AS expected, count(*) FILTER (c_acctbal >= 0) AS succeeded, count(*) FILTER (c_acctbal < 0) AS failed, CASE WHEN count(*) FILTER (c_acctbal < 0) = 0 THEN 'complete' ELSE 'partial_failure' END AS state FROM customer")
def board_summary(spark, sf):
    t = read_table(spark, sf, "customer")
    board = t.select(F.col("c_name").alias("model"), F.when(F.col("c_acctbal") >= 0, "succeeded").otherwise("failed").alias("state"))
    return tracking.leaderboard_summary(board)


@query("t1_search")
def searched(spark, sf):
    t = samples(spark, sf).select("row_id", "quantity", "full_tax", "price")
    best, table = search(t, MENU[("regression", "ridge")], ["quantity", "full_tax"], "price", "row_id", trials=3)
    return rounded(table, 4)


@query("t1_library_search")
def library(spark, sf):
    t = VectorAssembler(inputCols=["quantity", "full_tax"], outputCol="features").transform(samples(spark, sf)).select("features", F.col("price").alias("label"))
    lr = LinearRegression(solver="normal")
    model = library_search(lr, {lr.regParam: [0.0, 10.0], lr.elasticNetParam: [0.0, 1.0]}, RegressionEvaluator(metricName="r2"), t)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.validationMetrics)], "trial int, r2 double"), 3)


@query("t2_network_settings")
def network(spark, sf):
    t = samples(spark, sf).withColumn("q", F.col("quantity") / 25 - 1).withColumn("p", F.col("price") / 50000)
    entry = MENU[("regression", "mlp")]
    rows = []
    for i, s in enumerate(draw_settings(entry, 2)):
        net = entry.fit(t, ["q"], "p", "row_id", **s, max_iter=5, solver="lbfgs")
        rows.append((i, str(s["hidden"]), net(t).agg(F.avg("prediction")).first()[0]))
    return rounded(spark.createDataFrame(rows, "trial int, hidden string, mean double"), 3)


@query("t3_no_search_rule", "SELECT 'linear' AS model, 1 AS settings, count(*) AS n FROM lineitem UNION ALL SELECT 'polynomial', 1, count(*) FROM lineitem")
def no_search(spark, sf):
    n = samples(spark, sf).agg(F.count("*").alias("n"))
    out = None
    for name in ("linear", "polynomial"):
        one = n.select(F.lit(name).alias("model"), F.lit(len(draw_settings(MENU[("regression", name)]))).cast("long").alias("settings"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("t4_all_models")
def all_models(spark, sf):
    t = random_split(samples(spark, sf), "row_id", 0.2).select("row_id", "quantity", "full_tax", (F.col("price") / 10000).alias("p"), "split")
    names = ["linear", "polynomial", "decision_tree", "ridge", "lasso", "elastic_net", "bayesian_ridge", "sgd"]
    board = run_all(t.filter("split = 'train'"), t.filter("split = 'test'"), "regression", ["quantity", "full_tax"], "p", "row_id", names, {"elastic_net": {"l1_ratio": "wrong"}})
    return rounded(board.select("model", "state", "metric"), 3)


@query("t5_score_application", f"WITH {APP_SQL} SELECT row_id, round(a * quantity + b, 3) + 0.0 AS \"Predicted_price\" FROM a, g WHERE app")
def score_app(spark, sf):
    prep, model, app = _fit_app(spark, sf)
    return rounded(score_table(app, "row_id", prep.transform, {"price": model.transform}, ["quantity"]), 3)


@query("t5_score_stream", f"WITH {APP_SQL} SELECT row_id, round(a * quantity + b, 3) + 0.0 AS \"Predicted_price\" FROM a, g WHERE app")
def scored_stream(spark, sf):
    prep, model, app = _fit_app(spark, sf)
    root = scratch_path(spark, "stream")
    app.write.parquet(f"{root}/in")
    stream = read_stream(spark, f"{root}/in", app.schema)
    run = score_stream(stream, lambda d: score_table(d, "row_id", prep.transform, {"price": model.transform}, ["quantity"]), f"{root}/out", f"{root}/state")
    run.awaitTermination()
    return rounded(spark.read.parquet(f"{root}/out"), 3)


@query("workflow_regression")
def workflow(spark, sf):
    t = samples(spark, sf)
    flow = Workflow(
        TableSpec("row_id", ("quantity", "discount", "tax"), ("price",)), "regression", "xgboost",
        Preparation(("quantity", "discount", "tax"), ("price",), formulas={"unit": "quantity / 10"}), {"rounds": 2, "max_depth": 3},
    )
    return rounded(flow.run(t).scores(), 3)


# ---------------------------------------------------------------- one row per mode of the run
@query("workflow_clustering", f"WITH RECURSIVE {vectors_sql(4)}, {DBSCAN_SQL} SELECT * FROM flat")
def workflow_clustering(spark, sf):
    run = PatternRun(TableSpec("vec_id", tuple(dims(4))), "clustering", "dbscan", Preparation(tuple(dims(4))))
    return run.run(vectors(spark, sf, 4), eps=EPS, min_samples=MIN_SAMPLES)


@query("workflow_decomposition", PCA_SQL + ' SELECT vec_id, round((x0 - m0) * f1 * u0 + (x1 - m1) * f1 * u1, 6) + 0.0 AS "PC1", round((x0 - m0) * f2 * u1 - (x1 - m1) * f2 * u0, 6) + 0.0 AS "PC2" FROM vectors, s')
def workflow_decomposition(spark, sf):
    run = PatternRun(TableSpec("vec_id", tuple(dims(2))), "decomposition", "pca", Preparation(tuple(dims(2))))
    return rounded(run.run(vectors(spark, sf, 2), k=2))


@query("workflow_anomaly", LOF_SQL)
def workflow_anomaly(spark, sf):
    run = PatternRun(TableSpec("vec_id", tuple(dims(64))), "anomaly", "local_outlier_factor", Preparation(tuple(dims(64))))
    return rounded(run.run(vectors(spark, sf, 64), k=20, contamination=0.1))


@query("workflow_two_targets", f"""{APP_SPLIT_SQL}, m AS (SELECT regr_slope(price, quantity) AS a, regr_intercept(price, quantity) AS b, regr_slope(full_tax, quantity) AS ta, regr_intercept(full_tax, quantity) AS tb FROM s WHERE NOT test)
 SELECT 'price' AS target, round(sqrt(avg(pow(price - a * quantity - b, 2))), 2) + 0.0 AS rmse FROM s, m WHERE test UNION ALL SELECT 'full_tax', round(sqrt(avg(pow(full_tax - ta * quantity - tb, 2))), 2) + 0.0 FROM s, m WHERE test""")
def workflow_two_targets(spark, sf):
    flow = Workflow(TableSpec("row_id", ("quantity",), ("price", "full_tax")), "regression", "linear", Preparation(("quantity",), ("price", "full_tax")))
    return rounded(flow.run(samples(spark, sf)).scores().select("target", "rmse"), 2)


# nearest neighbour on every training row: the class of an application row is the text of its closest row
@query("workflow_text_classes", f"""WITH {vectors_sql(64)}, {_split_sql(64)}, {_knn_sql(64, 1, 'vectors', 'train', False)}
 SELECT vec_id, 'class ' || nlabel AS "Predicted_name" FROM edges""".replace(f"{hash_uniform_sql(42, 'vec_id')} >= 0.2", "vec_id IN (SELECT vec_id FROM ranked WHERE r > least(n - 1, greatest(1, ceil(n * 0.2))))")
 .replace("train AS (", f"ranked AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY {hash_uniform_sql(42, 'vec_id')}) AS r, count(*) OVER (PARTITION BY label) AS n FROM vectors), train AS ("))
def workflow_text_classes(spark, sf):
    t = vectors(spark, sf, 64).withColumn("name", F.concat(F.lit("class "), F.col("label").cast("string")))
    flow = Workflow(TableSpec("vec_id", tuple(dims(64)), ("name",)), "classification", "knn", Preparation(tuple(dims(64)), ("name",)), {"k": 1})
    return flow.run(t).score_application(t.drop("name", "label"))
