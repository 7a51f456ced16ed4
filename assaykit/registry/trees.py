"""Queries over tree models, boosting and perceptrons."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.models import forest, hist_tree, mlp, trees
from assaykit.operators import evaluate
from assaykit.registry.core import BINARY_FEATURES, SAMPLES_SQL, dims, query, rounded, samples, vectors
from assaykit.registry.linear import scaled_binary
from assaykit.sources.store import load_fitted, save_fitted
from assaykit.table import scratch_path

REG = ["quantity", "full_discount", "full_tax"]


def _price(spark, sf):
    return samples(spark, sf).withColumn("p", F.col("price") / 10000)


def _scored(model_out):
    return rounded(evaluate.regression_scores(model_out, "p", "prediction"), 3)


@query("r10_decision_tree_regression")
def dtr(spark, sf):
    t = _price(spark, sf)
    return _scored(trees.predict(trees.decision_tree_regression(t, REG, "p"), t))


# one cut of features with few values: every midpoint is tried in SQL
_FEW = ", ".join(f"SELECT '{f}' AS f, {f} AS v, price AS y FROM samples" for f in ("full_discount", "full_tax")).replace(", SELECT '", " UNION ALL SELECT '")
CUT_SQL = f"""WITH {SAMPLES_SQL}, x AS ({_FEW}), d AS (SELECT f, v, count(*) AS n, sum(y) AS s FROM x GROUP BY 1, 2),
 c AS (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS nv, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS s FROM d WINDOW w AS (PARTITION BY f ORDER BY v)),
 best AS (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) AS gain FROM c WHERE nv IS NOT NULL ORDER BY gain DESC, f, v LIMIT 1)"""
_SIDE = "CASE best.f WHEN 'full_discount' THEN full_discount ELSE full_tax END <= best.v"


@query("r10_tree_stump", CUT_SQL + f" SELECT row_id, round(CASE WHEN {_SIDE} THEN sl / nl ELSE (s - sl) / (n - nl) END, 3) + 0.0 AS prediction FROM samples, best")
def stump(spark, sf):
    t = samples(spark, sf)
    out = trees.predict(trees.decision_tree_regression(t, REG[1:], "price", 1), t)
    return rounded(out.select("row_id", "prediction"), 3)


@query("r10_binned_stump", CUT_SQL + f" SELECT row_id, round(CASE WHEN {_SIDE} THEN sl / nl ELSE (s - sl) / (n - nl) END, 3) + 0.0 AS prediction FROM samples, best")
def binned_stump(spark, sf):
    t = samples(spark, sf)
    model = forest.decision_tree(t, REG[1:], "price", "row_id", max_depth=1)
    return rounded(model.transform(t).select("row_id", "prediction"), 3)


ONE_ROUND_SQL = CUT_SQL + f" SELECT row_id, round(s / n + 0.3 * CASE WHEN {_SIDE} THEN (sl - nl * s / n) / (nl + 1) ELSE ((s - sl) - (n - nl) * s / n) / (n - nl + 1) END, 3) + 0.0 AS prediction FROM samples, best"


@query("io8_model_store", ONE_ROUND_SQL)
def model_store(spark, sf):
    """A fitted model that went through the store predicts what the fit did."""
    t = samples(spark, sf)
    model = hist_tree.xgb_regression(t, REG[1:], "price", "row_id", rounds=1, max_depth=1)
    again = load_fitted(spark, save_fitted(spark, model, scratch_path(spark, "model")))
    return rounded(again.transform(t).select("row_id", "prediction"), 3)


@query("r14_one_round", CUT_SQL + f" SELECT row_id, round(s / n + 0.3 * CASE WHEN {_SIDE} THEN (sl - nl * s / n) / (nl + 1) ELSE ((s - sl) - (n - nl) * s / n) / (n - nl + 1) END, 3) + 0.0 AS prediction FROM samples, best")
def one_round(spark, sf):
    t = samples(spark, sf)
    model = hist_tree.xgb_regression(t, REG[1:], "price", "row_id", rounds=1, max_depth=1)
    return rounded(model.transform(t).select("row_id", "prediction"), 3)


@query("r11_random_forest_regression")
def rfr(spark, sf):
    t = _price(spark, sf)
    return _scored(trees.predict(trees.random_forest_regression(t, REG, "p", trees=20), t))


@query("r11_out_of_bag")
def rf_oob(spark, sf):
    t = _price(spark, sf).select("row_id", *REG, "p")
    model = forest.random_forest(t, REG, "p", "row_id", trees=100, max_depth=5)
    bag = model.out_of_bag(t, "row_id").select("row_id", "oob_trees", "oob_prediction")
    return rounded(bag, 4)


@query("r12_extra_trees_regression")
def etr(spark, sf):
    t = _price(spark, sf)
    return _scored(hist_tree.random_cut_forest(t, REG, "p", "row_id", trees=10, max_depth=5).transform(t))


@query("r13_gradient_boosting_regression")
def gbr(spark, sf):
    t = samples(spark, sf)
    binning = hist_tree.fit_binning(t, REG)
    out = None
    for loss in ("squared_error", "absolute_error", "huber", "quantile"):
        model = hist_tree.gradient_boosting_regression(t, REG, "price", "row_id", loss=loss, rounds=4, rate=0.5, binning=binning)
        one = rounded(evaluate.regression_scores(model.transform(t), "price", "prediction"), 3).withColumn("loss", F.lit(loss))
        out = one if out is None else out.unionByName(one)
    return out


@query("r14_xgboost_regression")
def xgbr(spark, sf):
    t = _price(spark, sf)
    model = hist_tree.xgb_regression(t, ["quantity", "discount", "tax"], "p", "row_id", rounds=5, max_depth=4)
    return _scored(model.transform(t))


@query("r15_mlp_regression")
def mlpr(spark, sf):
    t = _price(spark, sf).withColumn("q", F.col("quantity") / 25 - 1)
    return _scored(mlp.fit_network(t, ["q", "full_tax"], "p", (8, 4), "tanh", "lbfgs", max_iter=15).transform(t))


def _classes(model_out, key="vec_id"):
    return model_out.select(key, F.col("prediction").cast("long").alias("prediction"))


@query("c3_decision_tree_classification")
def dtc(spark, sf):
    t = vectors(spark, sf, 16)
    return _classes(trees.predict(trees.decision_tree_classification(t, dims(16), "label", "entropy", 6), t))


@query("c4_random_forest_classification")
def rfc(spark, sf):
    t = vectors(spark, sf, 16)
    return _classes(trees.predict(trees.random_forest_classification(t, dims(16), "label", trees=20), t))


@query("c4_out_of_bag")
def rfc_oob(spark, sf):
    t = vectors(spark, sf, 64)
    model = forest.random_forest(t, dims(64), "label", "vec_id", classes=tuple(range(10)), trees=100, max_depth=4, min_split=4)
    return model.out_of_bag(t, "vec_id").select("vec_id", "oob_trees", F.col("oob_prediction").cast("long").alias("oob_prediction"))


@query("c5_extra_trees_out_of_bag")
def etc_oob(spark, sf):
    t = vectors(spark, sf, 64)
    model = forest.extra_trees(t, dims(64), "label", "vec_id", classes=tuple(range(10)), trees=100, max_depth=4, criterion="entropy", bootstrap=True)
    return model.out_of_bag(t, "vec_id").select("vec_id", "oob_trees", F.col("oob_prediction").cast("long").alias("oob_prediction"))


@query("c5_extra_trees_classification")
def etc(spark, sf):
    t = vectors(spark, sf, 16)
    return _classes(hist_tree.random_cut_forest(t, dims(16), "label", "vec_id", trees=10, max_depth=6, classes=tuple(range(10))).transform(t))


@query("c6_gradient_boosting_classification")
def gbc(spark, sf):
    t = scaled_binary(spark, sf)
    return _classes(hist_tree.gradient_boosting_classification(t, BINARY_FEATURES, "quality", "doc_id", rounds=8).transform(t), "doc_id")


@query("c6_gradient_boosting_exponential")
def gbc_exp(spark, sf):
    t = scaled_binary(spark, sf)
    model = hist_tree.gradient_boosting_classification(t, BINARY_FEATURES, "quality", "doc_id", loss="exponential", rounds=6)
    return _classes(model.transform(t), "doc_id")


@query("c7_xgboost_classification")
def xgbc(spark, sf):
    t = vectors(spark, sf, 16)
    return _classes(hist_tree.xgb_classification(t, dims(16), "label", "vec_id", rounds=3, max_depth=3).transform(t))


@query("c8_adaboost")
def ada(spark, sf):
    t = scaled_binary(spark, sf)
    return _classes(trees.adaboost(t, BINARY_FEATURES, "quality", (0, 1), rounds=4, max_depth=2).transform(t), "doc_id")


@query("c9_mlp_classification")
def mlpc(spark, sf):
    t = vectors(spark, sf, 16)
    model = mlp.fit_network(t, dims(16), "label", (20,), "relu", "lbfgs", max_iter=20, classes=tuple(range(10)))
    return _classes(model.transform(t))


@query("e13_tree_importance")
def importance(spark, sf):
    t = _price(spark, sf)
    return rounded(trees.tree_importance(trees.decision_tree_regression(t, REG, "p"), REG, spark), 4)


@query("e13_boosting_importance")
def gain(spark, sf):
    t = _price(spark, sf)
    model = hist_tree.xgb_regression(t, REG, "p", "row_id", rounds=2, max_depth=3)
    out = model.importance(spark, "gain").withColumn("kind", F.lit("gain"))
    return rounded(out.unionByName(model.importance(spark, "weight").withColumn("kind", F.lit("weight"))), 4)


@query("e20_tree_structure")
def structure(spark, sf):
    t = _price(spark, sf)
    return rounded(trees.tree_structure(trees.decision_tree_regression(t, REG, "p", 3), REG, spark), 4)


@query("e20_tree_nodes")
def tree_nodes(spark, sf):
    t = _price(spark, sf)
    model = forest.decision_tree(t, REG, "p", "row_id", max_depth=3)
    return rounded(model.nodes(spark).select("node", "feature", "cut", "left", "right", "impurity", "weight", F.get("value", F.lit(0)).alias("value")), 3)


@query("e21_loss_curve")
def losses(spark, sf):
    t = _price(spark, sf).withColumn("q", F.col("quantity") / 25 - 1)
    return rounded(mlp.fit_network(t, ["q"], "p", (4,), "logistic", "adam", learning_rate=0.05, max_iter=8).loss_curve(spark), 4)
