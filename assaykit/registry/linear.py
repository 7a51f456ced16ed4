"""Queries over linear models and score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.models import linear, logistic
from assaykit.operators import checks, evaluate, split
from assaykit.operators.sums import balanced
from assaykit.plans.preparation import Preparation
from assaykit.registry.core import BINARY_FEATURES, BINARY_SQL, SAMPLES_SQL, binary_task, dims, query, rounded, rsql, samples, vectors, vectors_sql
from assaykit.table import TableSpec, hash_uniform_sql, read_table

U42 = hash_uniform_sql(42, "row_id")


@query("r1_linear_regression", f"""WITH {SAMPLES_SQL}, m AS (SELECT avg(discount) AS fd, avg(tax) AS ft FROM samples WHERE {U42} >= 0.2),
 i AS (SELECT row_id, price, quantity, coalesce(discount, fd) AS d, coalesce(tax, ft) AS t, {U42} >= 0.2 AS train FROM samples, m),
 s1 AS (SELECT regr_slope(d, quantity) AS a, regr_intercept(d, quantity) AS b FROM i WHERE train),
 r1 AS (SELECT i.*, d - a * quantity - b AS rd FROM i, s1),
 s2 AS (SELECT regr_slope(t, quantity) AS a, regr_intercept(t, quantity) AS b, regr_slope(t, rd) AS e FROM r1 WHERE train),
 r2 AS (SELECT r1.*, t - a * quantity - b - e * rd AS rt FROM r1, s2),
 s3 AS (SELECT regr_slope(price, quantity) AS a, regr_intercept(price, quantity) AS b, regr_slope(price, rd) AS e, regr_slope(price, rt) AS f FROM r2 WHERE train),
 p AS (SELECT price AS y, a * quantity + b + e * rd + f * rt AS p FROM r2, s3 WHERE NOT train)
 SELECT count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 3) + 0.0 AS rmse, round(avg(abs(y - p)), 3) + 0.0 AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 8) + 0.0 AS r2, round(1 - var_pop(y - p) / var_pop(y), 8) + 0.0 AS explained_variance FROM p""")
def flagship(spark, sf):
    """Checked table -> split -> impute and standardise on train -> linear fit -> scores on test."""
    spec = TableSpec("row_id", ("quantity", "discount", "tax"), ("price",))
    t = samples(spark, sf).select("row_id", *spec.features, *spec.targets)
    checks.require_clean(checks.check_rows(t, checks.training_rules(spec, allow_missing=True), "row_id"))
    t = split.random_split(t, "row_id", 0.2, 42)
    train, test = t.filter("split = 'train'"), t.filter("split = 'test'")
    train = balanced(train.select(*spec.features, *spec.targets)).persist()
    prep = Preparation(spec.features, spec.targets, impute="mean", scale="standardize").fit(train)
    model = linear.linear_regression(prep.transform(train), prep.features, "price")
    train.unpersist()
    out = evaluate.regression_scores(model.transform(prep.transform(test)), "price", "prediction")
    return rounded(out.drop("mse"), {"rmse": 3, "mae": 3, "r2": 8, "explained_variance": 8})


@query("r2_polynomial_regression", f"""WITH {SAMPLES_SQL}, z AS (SELECT row_id, price AS y, quantity AS u, quantity * quantity AS v FROM samples),
 g AS (SELECT avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy FROM z),
 w AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS a, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS b FROM g)
 SELECT row_id, round(my + a * (u - mu) + b * (v - mv), 2) + 0.0 AS prediction FROM z, w""")
def poly(spark, sf):
    t = samples(spark, sf)
    model = linear.polynomial_regression(t, ["quantity"], "price", 2)
    return rounded(model.transform(t).select("row_id", "prediction"), 2)


RIDGE_SQL = """g AS (SELECT count(*)::DOUBLE AS n, avg(price) AS my, avg(quantity) AS m1, avg(full_tax) AS m2, var_pop(quantity) * count(*) AS s11, var_pop(full_tax) * count(*) AS s22,
 covar_pop(quantity, full_tax) * count(*) AS s12, covar_pop(quantity, price) * count(*) AS s1, covar_pop(full_tax, price) * count(*) AS s2 FROM samples),
 w AS (SELECT *, (s1 * (s22 + a) - s2 * s12) / ((s11 + a) * (s22 + a) - s12 * s12) AS w1, (s2 * (s11 + a) - s1 * s12) / ((s11 + a) * (s22 + a) - s12 * s12) AS w2 FROM (SELECT *, {alpha} AS a FROM g))
 SELECT round(w1, {d}) + 0.0 AS w1, round(w2, {d}) + 0.0 AS w2, round(my - w1 * m1 - w2 * m2, {d}) + 0.0 AS intercept FROM w"""


def _weights(spark, model, digits):
    row = {f"w{i + 1}": float(w) for i, w in enumerate(model.coefficients)}
    return row | {"intercept": model.intercept}


def _one_row(t, model, digits):
    cols = [F.lit(float(w)).alias(f"w{i + 1}") for i, w in enumerate(model.coefficients)]
    return rounded(t.agg(F.count("*").alias("_n")).select(*cols, F.lit(float(model.intercept)).alias("intercept")), digits)


@query("r3_ridge", f"WITH {SAMPLES_SQL}, " + RIDGE_SQL.format(alpha="50.0", d=3))
def ridge(spark, sf):
    t = samples(spark, sf)
    return _one_row(t, linear.ridge(t, ["quantity", "full_tax"], "price", alpha=50.0), 3)


@query("r4_lasso", f"WITH {SAMPLES_SQL} SELECT round(w, 3) + 0.0 AS w1, round(my - w * mx, 2) + 0.0 AS intercept FROM (SELECT avg(price) AS my, avg(quantity) AS mx, sign(covar_pop(price, quantity)) * greatest(abs(covar_pop(price, quantity)) - 100, 0) / var_pop(quantity) AS w FROM samples)")
def lasso(spark, sf):
    t = samples(spark, sf)
    return _one_row(t, linear.lasso(t, ["quantity"], "price", alpha=100.0), {"w1": 3, "intercept": 2})


@query("r5_elastic_net", f"WITH {SAMPLES_SQL} SELECT round(w, 3) + 0.0 AS w1, round(my - w * mx, 2) + 0.0 AS intercept FROM (SELECT avg(price) AS my, avg(quantity) AS mx, sign(covar_pop(price, quantity)) * greatest(abs(covar_pop(price, quantity)) - 10 * 0.5, 0) / (var_pop(quantity) + 10 * 0.5) AS w FROM samples)")
def enet(spark, sf):
    t = samples(spark, sf)
    return _one_row(t, linear.elastic_net(t, ["quantity"], "price", alpha=10.0, l1_ratio=0.5), {"w1": 3, "intercept": 2})


@query("r6_sgd_squared_error", f"WITH {SAMPLES_SQL}, " + RIDGE_SQL.format(alpha="n * 0.01", d=3))
def sgd_square(spark, sf):
    t = samples(spark, sf)
    return _one_row(t, linear.sgd_regression(t, ["quantity", "full_tax"], "price", alpha=0.01).linear(), 3)


@query("r6_sgd_losses")
def sgd_losses(spark, sf):
    t = samples(spark, sf)
    out = None
    for loss, penalty in (("huber", "l1"), ("epsilon_insensitive", "l2"), ("squared_epsilon_insensitive", "elasticnet")):
        scaled = t.withColumn("p", F.col("price") / 10000)
        model = linear.sgd_regression(scaled, ["quantity", "full_tax"], "p", loss=loss, penalty=penalty, alpha=0.001, max_iter=15).linear()
        one = _one_row(t, model, 4).withColumn("loss", F.lit(loss))
        out = one if out is None else out.unionByName(one)
    return out


@query("r7_bayesian_ridge", f"""WITH RECURSIVE {SAMPLES_SQL}, g AS (SELECT count(*)::DOUBLE AS n, avg(quantity) AS mx, avg(price) AS my, var_pop(quantity) * count(*) AS xx, covar_pop(quantity, price) * count(*) AS xy, var_pop(price) * count(*) AS yy FROM samples),
 it(k, w, alpha, lam, done) AS (SELECT 0, NULL::DOUBLE, 1 / (yy / n + 2.220446049250313e-16), 1.0::DOUBLE, false FROM g
  UNION ALL SELECT k + 1, v, (n - gam + 2e-6) / (greatest(0, yy - 2 * v * xy + v * v * xx) + 2e-6), (gam + 2e-6) / (v * v + 2e-6), coalesce(abs(v - w) < 1e-3, false)
  FROM (SELECT it.*, g.*, xy / (xx + lam / alpha) AS v, alpha * xx / (lam + alpha * xx) AS gam FROM it, g WHERE NOT done AND k < 300)),
 e AS (SELECT *, xy / (xx + lam / alpha) AS slope FROM (SELECT * FROM it ORDER BY k DESC LIMIT 1), g)
 SELECT row_id, round(my + slope * (quantity - mx), 2) + 0.0 AS prediction, round(sqrt(1 / alpha + (quantity - mx) * (quantity - mx) / (alpha * xx + lam)), 2) + 0.0 AS prediction_std FROM samples, e""")
def bayes(spark, sf):
    t = samples(spark, sf)
    model = linear.bayesian_ridge(t, ["quantity"], "price")
    return rounded(model.transform(t).select("row_id", "prediction", "prediction_std"), 2)


@query("r9_svm_regression")
def svr(spark, sf):
    t = samples(spark, sf).withColumn("p", F.col("price") / 10000).withColumn("q", F.col("quantity") / 10)
    model = linear.svm_regression(t, ["q", "full_tax"], "p", "row_id", "rbf", landmarks=30, max_iter=10)
    return rounded(evaluate.regression_scores(model.transform(t), "p", "prediction"), 3)


@query("r16_multi_target", f"WITH {SAMPLES_SQL} SELECT 'price' AS target, {rsql('regr_slope(price, quantity)', 'w1', 3)}, {rsql('regr_intercept(price, quantity)', 'intercept', 3)} FROM samples UNION ALL SELECT 'full_tax', {rsql('regr_slope(full_tax, quantity)', 'w1', 3)}, {rsql('regr_intercept(full_tax, quantity)', 'intercept', 3)} FROM samples")
def multi(spark, sf):
    t = samples(spark, sf)
    models = linear.multi_target(t, ["quantity"], ["price", "full_tax"])
    out = None
    for name, m in models.items():
        one = _one_row(t, m, 3).withColumn("target", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def scaled_binary(spark, sf):
    t = binary_task(spark, sf)
    prep = Preparation(BINARY_FEATURES, scale="standardize").fit(t)
    return prep.transform(t)


@query("c1_logistic_regression")
def logit(spark, sf):
    t = scaled_binary(spark, sf)
    out = logistic.logistic_regression(t, BINARY_FEATURES, "quality").transform(t)
    return rounded(out.select("doc_id", F.col("prediction").cast("long").alias("prediction"), F.col("probability")[1].alias("p1")), 4)


def _newton_sql(steps: int = 12) -> str:
    """Logistic regression on one feature by unrolled Newton steps, slope penalised by w^2 / 2."""
    out = ["n0 AS (SELECT 0.0::DOUBLE AS w, 0.0::DOUBLE AS b)"]
    for i in range(steps):
        out.append(
            f"n{i + 1} AS MATERIALIZED (SELECT w + (gw * hbb - gb * hwb) / (hww * hbb - hwb * hwb) AS w, b + (gb * hww - gw * hwb) / (hww * hbb - hwb * hwb) AS b FROM ("
            f"SELECT any_value(w) AS w, any_value(b) AS b, sum((y - p) * x) - any_value(w) AS gw, sum(y - p) AS gb, sum(p * (1 - p) * x * x) + 1 AS hww, sum(p * (1 - p) * x) AS hwb, sum(p * (1 - p)) AS hbb"
            f" FROM (SELECT *, 1 / (1 + exp(-(w * x + b))) AS p FROM z, n{i})))"
        )
    return ", ".join(out) + f" SELECT doc_id, CASE WHEN w * x + b > 0 THEN 1 ELSE 0 END::BIGINT AS prediction, round(1 / (1 + exp(-(w * x + b))), 4) + 0.0 AS p1 FROM z, n{steps}"


@query("c1_logistic_one_feature", f"WITH {BINARY_SQL}, z AS (SELECT doc_id, quality AS y, (n_lines - avg(n_lines) OVER ()) / stddev_pop(n_lines) OVER () AS x FROM binary_task), {_newton_sql()}")
def logit_one(spark, sf):
    t = scaled_binary(spark, sf)
    out = logistic.logistic_regression(t, ["n_lines"], "quality").transform(t)
    return rounded(out.select("doc_id", F.col("prediction").cast("long").alias("prediction"), F.col("probability")[1].alias("p1")), 4)


@query("c2_svm_classification")
def svc(spark, sf):
    t = scaled_binary(spark, sf)
    model = linear.svm_classification(t, BINARY_FEATURES, "quality", "doc_id", (0, 1), "rbf", landmarks=40, max_iter=15)
    prob = linear.margin_probability(model, t, "quality")
    out = model.transform(t).withColumn("margin", F.col("margins")[0])
    return rounded(out.select("doc_id", "prediction", (1 / (1 + F.exp(-prob.margin()))).alias("p1")), 3)


@query("c11_sgd_classification")
def sgd_cls(spark, sf):
    t = vectors(spark, sf, 16)
    model = linear.sgd_classification(t, dims(16), "label", tuple(range(10)), "modified_huber", alpha=0.001, max_iter=10)
    return model.transform(t).select("vec_id", F.col("prediction").cast("long").alias("prediction"))


# ---------------------------------------------------------------- scores on fixed predictions
FIXED_SQL = f"WITH {BINARY_SQL}, f AS (SELECT doc_id, quality, n_chars / 1000 AS score, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END::BIGINT AS guess FROM binary_task)"


def fixed(spark, sf):
    t = binary_task(spark, sf)
    return t.select("doc_id", "quality", (F.col("n_chars") / 1000).alias("score"), F.when(F.col("n_chars") > 1500, 1).otherwise(0).cast("long").alias("guess"))


@query("e1_regression_scores", f"WITH {SAMPLES_SQL}, p AS (SELECT price AS y, quantity * 2000 AS p FROM samples) SELECT count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 3) + 0.0 AS rmse, round(avg(abs(y - p)), 3) + 0.0 AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 8) + 0.0 AS r2, round(1 - var_pop(y - p) / var_pop(y), 8) + 0.0 AS explained_variance FROM p")
def reg_scores(spark, sf):
    t = samples(spark, sf).withColumn("p", F.col("quantity") * 2000)
    return rounded(evaluate.regression_scores(t, "price", "p").drop("mse"), {"rmse": 3, "mae": 3, "r2": 8, "explained_variance": 8})


MULTI_SQL = f"WITH {vectors_sql(2)}, f AS (SELECT label AS y, CASE WHEN x0 > 0 THEN label ELSE (label + 1) % 10 END AS p FROM vectors), k AS (SELECT DISTINCT y AS class FROM f UNION SELECT DISTINCT p FROM f), s AS (SELECT class, count(*) FILTER (y = class) AS support, count(*) FILTER (p = class) AS called, count(*) FILTER (y = class AND p = class) AS hit FROM f, k GROUP BY 1), r AS (SELECT *, coalesce(hit / nullif(called, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, coalesce(2.0 * hit / nullif(called + support, 0), 0) AS f1 FROM s)"


def multi_fixed(spark, sf):
    t = vectors(spark, sf, 2)
    return t.select("vec_id", F.col("label").alias("y"), F.when(F.col("x0") > 0, F.col("label")).otherwise((F.col("label") + 1) % 10).alias("p"))


_AVG = "SELECT '{a}' AS average, round((SELECT sum(hit) / sum(support) FROM r), 8) + 0.0 AS accuracy, {p}, {r}, {f} FROM r"


@query("e2_classification_scores", MULTI_SQL + " " + " UNION ALL ".join([
    _AVG.format(a="micro", p=rsql("sum(hit) / sum(support)", "precision", 8), r=rsql("sum(hit) / sum(support)", "recall", 8), f=rsql("sum(hit) / sum(support)", "f1", 8)),
    _AVG.format(a="macro", p=rsql("avg(precision)", "precision", 8), r=rsql("avg(recall)", "recall", 8), f=rsql("avg(f1)", "f1", 8)),
    _AVG.format(a="weighted", p=rsql("sum(precision * support) / sum(support)", "precision", 8), r=rsql("sum(recall * support) / sum(support)", "recall", 8), f=rsql("sum(f1 * support) / sum(support)", "f1", 8)),
]))
def cls_scores(spark, sf):
    t = multi_fixed(spark, sf)
    out = None
    for a in ("micro", "macro", None):
        one = evaluate.classification_scores(t, "y", "p", a)
        out = one if out is None else out.unionByName(one)
    return rounded(out, 8)


@query("e2_binary_scores", FIXED_SQL + " SELECT 'binary' AS average, round(avg(CASE WHEN quality = guess THEN 1.0 ELSE 0 END), 8) + 0.0 AS accuracy, round(count(*) FILTER (quality = 1 AND guess = 1) / count(*) FILTER (guess = 1), 8) + 0.0 AS precision, round(count(*) FILTER (quality = 1 AND guess = 1) / count(*) FILTER (quality = 1), 8) + 0.0 AS recall, round(2.0 * count(*) FILTER (quality = 1 AND guess = 1) / (count(*) FILTER (quality = 1) + count(*) FILTER (guess = 1)), 8) + 0.0 AS f1 FROM f")
def bin_scores(spark, sf):
    return rounded(evaluate.classification_scores(fixed(spark, sf), "quality", "guess"), 8)


@query("e3_class_report", MULTI_SQL + " SELECT class, round(precision, 8) + 0.0 AS precision, round(recall, 8) + 0.0 AS recall, round(f1, 8) + 0.0 AS f1, support, called, hit FROM r")
def report(spark, sf):
    return rounded(evaluate.class_report(multi_fixed(spark, sf), "y", "p"), 8)


@query("e3_report_averages", MULTI_SQL + " SELECT 'macro avg' AS class, round(avg(precision), 8) + 0.0 AS precision, round(avg(recall), 8) + 0.0 AS recall, round(avg(f1), 8) + 0.0 AS f1, sum(support)::BIGINT AS support FROM r UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 8) + 0.0, round(sum(recall * support) / sum(support), 8) + 0.0, round(sum(f1 * support) / sum(support), 8) + 0.0, sum(support)::BIGINT FROM r")
def report_avg(spark, sf):
    return rounded(evaluate.report_averages(multi_fixed(spark, sf), "y", "p"), 8)


@query("e4_confusion_matrix", FIXED_SQL + ' SELECT quality AS actual, count(*) FILTER (guess = 0) AS predicted_0, count(*) FILTER (guess = 1) AS predicted_1 FROM f GROUP BY 1 UNION ALL SELECT 2, 0, 0')
def confusion(spark, sf):
    out = evaluate.confusion_matrix(fixed(spark, sf), "quality", "guess", [0, 1, 2])
    return out.drop("predicted_2")


E5_U = hash_uniform_sql(42, "row_id")


@query("e5_cross_validation", f"WITH {SAMPLES_SQL}, f AS (SELECT quantity AS x, price AS y, floor({E5_U} * 10)::BIGINT AS fold FROM samples), k AS (SELECT k::BIGINT AS k FROM range(10) t(k)), m AS (SELECT k, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM f, k WHERE fold <> k GROUP BY k), s AS (SELECT k, sqrt(avg(pow(y - a * x - b, 2))) AS rmse, 1 - avg(pow(y - a * x - b, 2)) / var_pop(y) AS r2 FROM f JOIN m ON fold = k GROUP BY k) SELECT 'rmse' AS metric, round(avg(rmse), 4) + 0.0 AS mean, round(stddev_pop(rmse), 4) + 0.0 AS std FROM s UNION ALL SELECT 'r2', round(avg(r2), 4) + 0.0, round(stddev_pop(r2), 4) + 0.0 FROM s")
def cross_validation(spark, sf):
    t = split.hash_folds(samples(spark, sf), "row_id", 10, 42).select("fold", "quantity", "price")

    def fit_predict(train, test):
        return linear.linear_regression(train, ["quantity"], "price").transform(test)

    scores = evaluate.cross_validate(t, "fold", 10, fit_predict, lambda p: evaluate.regression_scores(p, "price", "prediction"))
    return rounded(evaluate.fold_summary(scores, ["rmse", "r2"]), 4)


@query("e6_stratified_folds", f"WITH u AS (SELECT vec_id, label::BIGINT AS label, row_number() OVER (PARTITION BY label ORDER BY {hash_uniform_sql(42, 'vec_id')}) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings), k AS (SELECT least(10, min(n)) AS k FROM u) SELECT label, (SELECT count(*) FROM range(1, 10) t(f) WHERE f < k AND r > ceil(n * f / k))::BIGINT AS fold, count(*) AS n FROM u, k GROUP BY 1, 2")
def strat_folds(spark, sf):
    folds, _ = split.stratified_folds(vectors(spark, sf, 1), "vec_id", "label", 10)
    return rounded(folds.groupBy("label", "fold").agg(F.count("*").alias("n")))


CURVE_SQL = FIXED_SQL + ", d AS (SELECT score AS threshold, sum(quality) AS p, count(*) - sum(quality) AS q FROM f GROUP BY 1), t AS (SELECT threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(q) OVER w)::BIGINT AS fp, (SELECT sum(p) FROM d) AS np, (SELECT sum(q) FROM d) AS nq, p FROM d WINDOW w AS (ORDER BY threshold DESC))"


@query("e7_e8_precision_recall", CURVE_SQL + " SELECT threshold, tp, fp, (np - tp)::BIGINT AS fn, (nq - fp)::BIGINT AS tn, round(tp / (tp + fp), 8) + 0.0 AS precision, round(tp / np, 8) + 0.0 AS recall, round(fp / nq, 8) + 0.0 AS fpr FROM t")
def curve(spark, sf):
    return rounded(evaluate.threshold_table(fixed(spark, sf), "quality", "score"), 8)


@query("e7_average_precision", CURVE_SQL + " SELECT round(sum(tp / (tp + fp) * p) / any_value(np), 8) + 0.0 AS average_precision FROM t")
def avg_prec(spark, sf):
    return rounded(evaluate.average_precision(fixed(spark, sf), "quality", "score"), 8)


@query("e9_roc_auc", FIXED_SQL + " SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 8) + 0.0 AS auc, count(DISTINCT a.doc_id) AS n_pos, count(DISTINCT b.doc_id) AS n_neg FROM f a, f b WHERE a.quality = 1 AND b.quality = 0")
def auc(spark, sf):
    return rounded(evaluate.roc_auc(fixed(spark, sf), "quality", "score"), 8)


@query("e10_binary_gate", "SELECT 'two classes' AS data, count(*) AS n, 'curves' AS outcome FROM labels UNION ALL SELECT 'many classes', count(*), 'notice' FROM embeddings")
def gate(spark, sf):
    out = None
    for name, t, y in (("two classes", read_table(spark, sf, "labels"), "quality"), ("many classes", read_table(spark, sf, "embeddings"), "label")):
        counts = split.class_counts(t, y)
        try:
            evaluate.require_binary(len(counts))
            outcome = "curves"
        except ValueError:
            outcome = "notice"
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("data"), "n", F.lit(outcome).alias("outcome"))
        out = one if out is None else out.unionByName(one)
    return out


@query("e14_linear_importance", f"WITH {vectors_sql(1)} SELECT 'x0' AS feature, round(regr_slope(label, x0), 5) + 0.0 AS coefficient FROM vectors")
def importance(spark, sf):
    t = vectors(spark, sf, 1)
    return rounded(linear.linear_regression(t, ["x0"], "label").importance(spark), 5)


@query("e14_logistic_importance")
def log_importance(spark, sf):
    t = scaled_binary(spark, sf)
    return rounded(logistic.logistic_regression(t, BINARY_FEATURES, "quality").coefficients(spark), 3)


@query("e15_formula_text", f"WITH {SAMPLES_SQL}, g AS (SELECT regr_slope(full_tax, quantity) * 1000 AS a, regr_intercept(full_tax, quantity) * 1000 AS b, count(*) AS n FROM samples) SELECT replace('tax = ' || round(a, 3) || '*quantity + ' || round(b, 3), '+ -', '- ') AS formula, n FROM g")
def formula_text(spark, sf):
    t = samples(spark, sf).withColumn("t1000", F.col("full_tax") * 1000)
    text = linear.linear_regression(t, ["quantity"], "t1000").formula("tax")
    return t.agg(F.lit(text).alias("formula"), F.count("*").alias("n"))


@query("e16_residual_table", f"WITH {SAMPLES_SQL} SELECT row_id, price AS actual, quantity * 2000 AS predicted, round(quantity * 2000 - price, 4) + 0.0 AS residual FROM samples")
def residuals(spark, sf):
    t = samples(spark, sf).withColumn("p", F.col("quantity") * 2000)
    return rounded(evaluate.residual_table(t, "row_id", "price", "p"), 4)
