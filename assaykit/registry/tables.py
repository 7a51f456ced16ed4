"""Queries over sources, projections, checks, profile, missing values, formulas and preparation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.functions.formula import fit_formulas
from assaykit.functions.normal import normal_tail_sql
from assaykit.operators import checks, columns, labels, missing, profile, scaling, selection, split
from assaykit.operators.expand import polynomial_features
from assaykit.operators.ordering import exact_quantiles
from assaykit.registry.core import (
    BINARY_FEATURES, BINARY_SQL, GEO_SQL, SAMPLE_FEATURES, SAMPLES_SQL, binary_task, geo, query, rounded, rsql, samples,
    union_all, vectors, vectors_sql,
)
from assaykit.sources import readers, sinks, tracking
from assaykit.table import TableSpec, c, hash_uniform_sql, read_table, scratch_path

SPEC = TableSpec("row_id", SAMPLE_FEATURES, ("price",))


# ---------------------------------------------------------------- sources and sinks
@query("io1_read_csv", """SELECT p_size AS size, count(*) AS n, round(sum(p_retailprice), 2) + 0.0 AS price,
  count(nullif(p_type, 'SMALL')) AS typed FROM part GROUP BY p_size""")
def read_csv(spark, sf):
    t = read_table(spark, sf, "part")
    path = scratch_path(spark, "csv")
    out = t.withColumn("p_type", F.when(F.col("p_type") == "SMALL", "n/a").otherwise(F.col("p_type")))
    sinks.save_table(out, path, "csv")
    back = readers.read_samples(spark, path)
    return rounded(back.groupBy(F.col("p_size").alias("size")).agg(
        F.count("*").alias("n"), F.sum("p_retailprice").alias("price"), F.count("p_type").alias("typed")
    ), 2)


@query("io2_header_names", """SELECT 'c_custkey' AS a, 'Unnamed: 1' AS b, 'c_name.1' AS d, count(*) AS n FROM customer""")
def header_names(spark, sf):
    t = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    names = readers.clean_header(["c_custkey", None, "c_name"])
    again = readers.clean_header(["c_name", "c_name"], rename_duplicates=True)
    named = t.toDF(*names)
    return named.agg(
        F.lit(named.columns[0]).alias("a"), F.lit(named.columns[1]).alias("b"), F.lit(again[1]).alias("d"),
        F.count(c(named.columns[1])).alias("n"),
    )


@query("io3_missing_tokens", """SELECT o_orderpriority AS priority, count(*) AS n,
  count(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END) AS known FROM orders GROUP BY 1""")
def missing_tokens(spark, sf):
    t = read_table(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "F", " NaN ").otherwise(F.col("o_orderstatus"))
    cleaned = readers.clean_cells(t.select("o_orderpriority", text.alias("s")))
    return cleaned.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("n"), F.count("s").alias("known")
    )


@query("io4_dataset_catalog", """SELECT 'nation' AS dataset, count(*) AS row_count, 3 AS column_count, 'training' AS role FROM nation
UNION ALL SELECT 'supplier', count(*), 4, 'unspecified' FROM supplier""")
def catalog(spark, sf):
    root = scratch_path(spark, "catalog")
    for name in ("nation", "supplier"):
        read_table(spark, sf, name).coalesce(1).write.option("header", "true").csv(f"{root}/{name}")
    files = readers.dataset_catalog(spark, root)
    names = {
        name: [r["file_name"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{root}/{name}")
               .select(F.element_at(F.split("path", "/"), -1).alias("file_name")).collect()]
        for name in ("nation", "supplier")
    }
    roles = {f: ("regression", "training") for f in names["nation"]}
    files = readers.dataset_catalog(spark, root, roles)
    dataset = F.when(F.col("file_name").isin(*names["nation"]), "nation").otherwise("supplier")
    return files.select(
        dataset.alias("dataset"), F.col("row_count").cast("long"), F.col("column_count").cast("long"), "role"
    )


@query("io5_inspect_table", """WITH s AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50)
SELECT 'o_custkey' AS feature, 'integer' AS inferred_type, count(o_custkey) AS sampled_non_null FROM s
UNION ALL SELECT 'o_orderkey', 'integer', count(o_orderkey) FROM s
UNION ALL SELECT 'o_orderstatus', 'string', count(o_orderstatus) FROM s
UNION ALL SELECT 'o_totalprice', 'number', count(o_totalprice) FROM s
UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority) FROM s""")
def inspect(spark, sf):
    t = read_table(spark, sf, "orders").drop("o_orderdate")
    return readers.inspect_columns(t, ["o_orderkey"]).select("feature", "inferred_type", "sampled_non_null")


@query("io6_save_with_identifier", "SELECT p_partkey AS row_id, round(p_retailprice, 2) + 0.0 AS price, cast(p_size AS BIGINT) AS size FROM part")
def save_identified(spark, sf):
    t = read_table(spark, sf, "part").select(F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), F.col("p_partkey").alias("row_id"))
    path = sinks.save_with_identifier(t, scratch_path(spark, "result"), "row_id")
    return rounded(spark.read.parquet(path), 2)


@query("io7_save_table", "SELECT round(p_retailprice, 2) + 0.0 AS price, cast(p_size AS BIGINT) AS size FROM part")
def save_plain(spark, sf):
    t = read_table(spark, sf, "part").select(F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    return rounded(spark.read.parquet(sinks.save_table(t, scratch_path(spark, "result"))), 2)


@query("io9_experiment_runs", """WITH runs AS (SELECT 'run-' || o_custkey AS run_id, max(o_orderdate) AS start_time FROM orders GROUP BY 1),
 newest AS (SELECT * FROM runs ORDER BY start_time DESC, run_id LIMIT 50)
 SELECT n.run_id, count(o.o_orderkey) AS n_metrics, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS n_finite
 FROM newest n JOIN orders o ON n.run_id = 'run-' || o.o_custkey GROUP BY 1""")
def tracked_runs(spark, sf):
    o = read_table(spark, sf, "orders").withColumn("run_id", F.concat(F.lit("run-"), "o_custkey"))
    runs = o.groupBy("run_id").agg(F.max("o_orderdate").alias("start_time"))
    newest = runs.orderBy(F.desc("start_time"), "run_id").limit(50)
    name = F.col("o_orderkey").cast("string")
    metrics = o.select("run_id", name.alias("name"), F.when(F.col("o_orderstatus") == "F", F.lit(float("inf"))).otherwise(F.col("o_totalprice")).alias("value"))
    params = o.select("run_id", name.alias("name"), F.col("o_orderpriority").alias("value"))
    out = tracking.attach_values(newest, params, metrics)
    return out.select(
        "run_id", F.size("metrics").cast("long").alias("n_metrics"),
        F.size(F.filter(F.map_values("metrics"), lambda v: v.isNotNull())).cast("long").alias("n_finite"),
    )


# ---------------------------------------------------------------- projections and checks
@query("pf1_select_ranges", "SELECT l_orderkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_discount, count(*) AS n FROM lineitem GROUP BY ALL")
def ranges(spark, sf):
    t = columns.select_ranges(read_table(spark, sf, "lineitem"), "[3, 4]; 1; 7; 3")
    return rounded(t.groupBy(*t.columns).agg(F.count("*").alias("n")), 10)


@query("pf2_sub_table", f"WITH {SAMPLES_SQL} SELECT flag, count(*) AS n, count(discount) AS discount, round(sum(price), 1) + 0.0 AS price FROM samples GROUP BY flag")
def sub_table(spark, sf):
    t = samples(spark, sf).withColumn("empty", F.lit(None).cast("double"))
    t = t.select("row_id", "quantity", "price", "discount", "empty", "flag")
    kept = columns.sub_table(t, "[2, 5]", keep=["row_id", "flag"])
    assert "empty" not in kept.columns
    return rounded(kept.groupBy("flag").agg(
        F.count("*").alias("n"), F.count("discount").alias("discount"), F.sum("price").alias("price")
    ), 1)


@query("pf3_numeric_only", "SELECT p_partkey, p_size::BIGINT AS p_size, round(p_retailprice, 2) + 0.0 AS p_retailprice FROM part")
def numeric(spark, sf):
    return rounded(columns.numeric_only(read_table(spark, sf, "part")), 2)


@query("pf4_choose_axes", "SELECT p_partkey, round(p_retailprice, 2) + 0.0 AS p_retailprice, p_size::BIGINT AS p_size FROM part")
def axes(spark, sf):
    t = read_table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(columns.choose_axes(t, [2, 1], keep=["p_partkey"]), 2)


@query("pf5_drop_incomplete", f"WITH {SAMPLES_SQL} SELECT flag, count(*) AS n, round(avg(price), 4) + 0.0 AS price FROM samples WHERE discount IS NOT NULL AND tax IS NOT NULL GROUP BY flag")
def drop_any(spark, sf):
    return rounded(columns.drop_incomplete(samples(spark, sf)).groupBy("flag").agg(F.count("*").alias("n"), F.avg("price").alias("price")), 4)


@query("pf6_drop_incomplete_subset", f"WITH {SAMPLES_SQL} SELECT flag, count(*) AS n, count(discount) AS discount FROM samples WHERE tax IS NOT NULL GROUP BY flag")
def drop_subset(spark, sf):
    return columns.drop_incomplete(samples(spark, sf), ["tax"]).groupBy("flag").agg(F.count("*").alias("n"), F.count("discount").alias("discount"))


@query("pf7_drop_empty_columns", "SELECT count(*) AS n, 3 AS width FROM supplier")
def drop_empty(spark, sf):
    t = read_table(spark, sf, "supplier").withColumn("s_name", F.lit(None).cast("string"))
    kept = columns.drop_empty_columns(t)
    return kept.agg(F.count("*").alias("n"), F.lit(len(kept.columns)).cast("long").alias("width"))


PF8_SQL = f"""WITH {SAMPLES_SQL}, dup AS (SELECT row_id FROM samples GROUP BY row_id HAVING count(*) > 1)
SELECT 'identifier_missing' AS rule, 'row_id' AS "column", count(*) FILTER (row_id IS NULL) AS n_bad FROM samples
UNION ALL SELECT 'target_missing', 'flag', count(*) FILTER (flag IS NULL) FROM samples
UNION ALL SELECT 'feature_not_finite', 'quantity', count(*) FILTER (quantity IS NULL) FROM samples
UNION ALL SELECT 'feature_not_finite', 'discount', count(*) FILTER (discount IS NULL) FROM samples
UNION ALL SELECT 'feature_not_finite', 'tax', count(*) FILTER (tax IS NULL) FROM samples
UNION ALL SELECT 'identifier_duplicate', 'row_id', count(*) FROM dup
UNION ALL SELECT 'class_below_two_rows', 'flag', 0
UNION ALL SELECT 'fewer_than_two_classes', 'flag', 0
UNION ALL SELECT 'split_smaller_than_classes', 'flag', 0
UNION ALL SELECT 'no_usable_row', '*', 0
UNION ALL SELECT 'neighbours_above_train_rows', '*', 0"""


@query("pf8_check_training_table", PF8_SQL)
def check_training(spark, sf):
    spec = TableSpec("row_id", ("quantity", "discount", "tax"), ("flag",))
    report = checks.check_training_table(samples(spark, sf), spec, "classification", neighbours=5)
    return report.select("rule", "column", "n_bad")


@query("pf9_check_application_table", f"""WITH {SAMPLES_SQL}, dup AS (SELECT row_id FROM samples GROUP BY row_id HAVING count(*) > 1)
SELECT 'identifier_missing' AS rule, 'row_id' AS "column", count(*) FILTER (row_id IS NULL) AS n_bad, NULL AS first_bad_row FROM samples
UNION ALL SELECT 'feature_not_finite', 'discount', count(*) FILTER (discount IS NULL), min(row_id) FILTER (discount IS NULL) FROM samples
UNION ALL SELECT 'identifier_duplicate', 'row_id', count(*), min(row_id) FROM dup
UNION ALL SELECT 'no_usable_row', '*', 0, NULL""")
def check_application(spark, sf):
    return checks.check_application_table(samples(spark, sf), TableSpec("row_id", ("discount",), ("price",)))


@query("pf10_check_ranges", f"""WITH {GEO_SQL}
SELECT 'latitude_range' AS rule, 'latitude' AS "column", count(*) FILTER (latitude < -90 OR latitude > 90) AS n_bad FROM geo
UNION ALL SELECT 'longitude_range', 'wide', count(*) FILTER (longitude * 1.5 NOT BETWEEN -180 AND 180) FROM geo
UNION ALL SELECT 'probability_range', 'odds', count(*) FILTER (probability + 0.25 > 1) FROM geo
UNION ALL SELECT 'age_negative', 'age', 0 FROM (SELECT 1)
UNION ALL SELECT 'age_max_below_age', 'late', count(*) FILTER (age_max - 25 < age) FROM geo""")
def check_ranges(spark, sf):
    t = geo(spark, sf).withColumn("wide", F.col("longitude") * 1.5).withColumn("odds", F.col("probability") + 0.25)
    t = t.withColumn("late", F.col("age_max") - 25)
    rules = checks.range_rules("latitude", "wide", "odds", "age", "late")
    return checks.check_rows(t, rules, "row_id").select("rule", "column", "n_bad")


@query("pf11_coordinate_columns", f"WITH {GEO_SQL} SELECT 'Latitude' AS lat, 'LONGITUDE' AS lon, count(*) AS n FROM geo")
def coordinates(spark, sf):
    t = geo(spark, sf).withColumnRenamed("latitude", "Latitude").withColumnRenamed("longitude", "LONGITUDE")
    lat, lon = columns.coordinate_columns(t)
    return t.agg(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"), F.count(c(lat)).alias("n"))


@query("pf12_split_abnormal", f"WITH {SAMPLES_SQL} SELECT 'all' AS part, count(*) AS n FROM samples UNION ALL SELECT 'normal', count(*) FROM samples WHERE price <= 90000 UNION ALL SELECT 'abnormal', count(*) FROM samples WHERE price > 90000")
def split_abnormal(spark, sf):
    t = samples(spark, sf).withColumn("is_abnormal", F.when(F.col("price") > 90000, -1).otherwise(1))
    parts = columns.flag_abnormal(t)
    out = None
    for name, part in zip(("all", "normal", "abnormal"), parts):
        one = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- row alignment
@query("j1_align_columns", "SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS price, o_orderstatus AS status FROM orders")
def align(spark, sf):
    t = read_table(spark, sf, "orders")
    left = t.select("o_orderkey", F.col("o_totalprice").alias("price"))
    return rounded(columns.align(left, t.select("o_orderkey", F.col("o_orderstatus").alias("status")), "o_orderkey"), 2)


J2_MAP = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "mid", "4-NOT SPECIFIED": "low", "5-LOW": "low"}


@query("j2_lookup_missing_labels", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')")
def lookup_missing(spark, sf):
    model = labels.LabelModel("o_orderpriority", ("high", "low"), mapping={k: v for k, v in J2_MAP.items() if k in ("1-URGENT", "2-HIGH", "5-LOW")})
    return model.missing(read_table(spark, sf, "orders"))


@query("j3_value_to_bin", "SELECT CASE WHEN o_totalprice <= 100000 THEN 'small' WHEN o_totalprice <= 300000 THEN 'mid' ELSE 'big' END AS label, count(*) AS n FROM orders GROUP BY 1")
def value_to_bin(spark, sf):
    t = read_table(spark, sf, "orders")
    model = labels.interval_labels(t, "o_totalprice", [100000.0, 300000.0], ["small", "mid", "big"])
    return model.label(t).groupBy("label").agg(F.count("*").alias("n"))


@query("j6_rows_of", "SELECT count(*) AS inside, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS outside FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def membership(spark, sf):
    cust = read_table(spark, sf, "customer").withColumnRenamed("c_custkey", "k")
    orders = read_table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    inside = columns.rows_of(cust, orders, "k").agg(F.count("*").alias("inside"))
    outside = columns.rows_of(cust, orders, "k", present=False).agg(F.count("*").alias("outside"))
    return inside.join(outside)


# ---------------------------------------------------------------- profile
A1_SQL = f"WITH {SAMPLES_SQL} " + union_all([
    f"SELECT '{n}' AS feature, count({n}) AS count, {rsql(f'avg({n})', 'mean')}, {rsql(f'stddev_samp({n})', 'std')}, {rsql(f'min({n})', 'min')}, "
    f"{rsql(f'quantile_cont({n}, 0.25)', 'q25')}, {rsql(f'quantile_cont({n}, 0.5)', 'q50')}, {rsql(f'quantile_cont({n}, 0.75)', 'q75')}, {rsql(f'max({n})', 'max')} FROM samples"
    for n in SAMPLE_FEATURES
])


@query("a1_describe", A1_SQL)
def describe(spark, sf):
    return rounded(profile.describe(samples(spark, sf), SAMPLE_FEATURES), 6)


@query("a2_column_info", "SELECT 'p_partkey' AS feature, count(p_partkey) AS non_null, 'bigint' AS type FROM part UNION ALL SELECT 'p_name', count(p_name), 'string' FROM part UNION ALL SELECT 'p_brand', count(p_brand), 'string' FROM part UNION ALL SELECT 'p_type', count(p_type), 'string' FROM part UNION ALL SELECT 'p_size', count(p_size), 'int' FROM part UNION ALL SELECT 'p_retailprice', count(p_retailprice), 'double' FROM part")
def info(spark, sf):
    return profile.column_info(read_table(spark, sf, "part"))


A3_SQL = f"WITH {SAMPLES_SQL} " + union_all([
    f"SELECT '{n}' AS feature, bool_or({n} IS NULL) AS has_null, count(*) - count({n}) AS n_null, {rsql(f'avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END)', 'null_ratio')} FROM samples"
    for n in SAMPLE_FEATURES
])


@query("a3_null_summary", A3_SQL)
def nulls(spark, sf):
    return rounded(profile.null_summary(samples(spark, sf), SAMPLE_FEATURES))


@query("a4_has_missing", f"WITH {SAMPLES_SQL} SELECT bool_or(quantity IS NULL OR price IS NULL OR discount IS NULL OR tax IS NULL) AS has_missing FROM samples")
def any_missing(spark, sf):
    return profile.has_missing(samples(spark, sf), SAMPLE_FEATURES)


@query("a5_null_ratio", f"WITH {SAMPLES_SQL} " + union_all([f"SELECT '{n}' AS feature, {rsql(f'avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END)', 'null_ratio')} FROM samples" for n in SAMPLE_FEATURES]))
def ratios(spark, sf):
    return rounded(profile.null_ratio(samples(spark, sf), SAMPLE_FEATURES))


@query("a6_correlation", f"WITH {SAMPLES_SQL} " + union_all([
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {rsql(f'corr({a}, {b})', 'corr', 8)} FROM samples" for a in SAMPLE_FEATURES for b in SAMPLE_FEATURES]))
def corr(spark, sf):
    return rounded(profile.correlation(samples(spark, sf), SAMPLE_FEATURES), 8)


def _hist_sql(value: str, names, bins: int = 10) -> str:
    parts = []
    for n in names:
        v = value.format(n)
        parts.append(f"""SELECT '{n}' AS feature, b.bin::BIGINT AS bin, round(lo + b.bin * step, 6) + 0.0 AS low, round(lo + (b.bin + 1) * step, 6) + 0.0 AS high, count(h.bin) AS n
 FROM (SELECT min({v}) AS lo, (max({v}) - min({v})) / {bins} AS step FROM samples) m CROSS JOIN range({bins}) b(bin)
 LEFT JOIN (SELECT least(floor(({v} - lo) / step), {bins - 1}) AS bin FROM samples, (SELECT min({v}) AS lo, (max({v}) - min({v})) / {bins} AS step FROM samples) WHERE {v} IS NOT NULL) h ON h.bin = b.bin
 GROUP BY b.bin, lo, step""")
    return f"WITH {SAMPLES_SQL} " + union_all([f"SELECT * FROM ({p})" for p in parts])


@query("a7_histogram", _hist_sql("{}", ("quantity", "price", "discount")))
def hist(spark, sf):
    return rounded(profile.histogram(samples(spark, sf), ("quantity", "price", "discount")))


@query("a8_log_histogram", _hist_sql("(CASE WHEN {0} > -1 THEN ln(1 + {0}) END)", ("quantity", "price")))
def log_hist(spark, sf):
    return rounded(profile.histogram(samples(spark, sf), ("quantity", "price"), transform="log1p"))


def _pp_sql(column: str, source: str) -> str:
    z = "((v - m) / s)"
    tail = normal_tail_sql("z")
    return f"""SELECT round(v, 6) + 0.0 AS value, n, round((n_before + (n + 1) / 2.0) / (total + 1), 8) + 0.0 AS observed,
 round(CASE WHEN z > 0 THEN 1 - {tail} ELSE {tail} END, 8) + 0.0 AS fitted
 FROM (SELECT v, n, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before, {z} AS z, total
 FROM (SELECT {column} AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1),
 (SELECT avg({column}) AS m, stddev_pop({column}) AS s, count({column}) AS total FROM {source}))"""


@query("a9_probability_table", f"WITH {SAMPLES_SQL}, filled AS (SELECT coalesce(discount, (SELECT avg(discount) FROM samples)) AS discount FROM samples) SELECT *, 'original' AS state FROM ({_pp_sql('discount', 'samples')}) UNION ALL SELECT *, 'imputed' AS state FROM ({_pp_sql('discount', 'filled')})")
def pp(spark, sf):
    t = samples(spark, sf)
    filled = missing.fit_imputer(t, ["discount"], "mean").transform(t)
    return rounded(profile.probability_tables(t, filled, "discount"), {"value": 6, "observed": 8, "fitted": 8})


@query("a10_value_counts", "SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY 1")
def counts(spark, sf):
    return rounded(profile.value_counts(read_table(spark, sf, "embeddings"), "label"))


@query("a11_distinct_counts", "SELECT 'l_returnflag' AS feature, count(DISTINCT l_returnflag) AS n_distinct FROM lineitem UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem")
def distincts(spark, sf):
    return profile.distinct_counts(read_table(spark, sf, "lineitem"), ["l_returnflag", "l_suppkey"])


@query("a12_distinct_in_order", "SELECT o_orderpriority, min(o_orderkey) AS first_row, count(*) AS n FROM orders GROUP BY 1")
def first_seen(spark, sf):
    return columns.distinct_in_order(read_table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


@query("a13_ratio_line", f"WITH {SAMPLES_SQL}, l AS (SELECT regr_slope(price, quantity) AS a, regr_intercept(price, quantity) AS b FROM samples) SELECT CASE WHEN price > a * quantity + b THEN 1 ELSE 0 END::BIGINT AS above_line, round(any_value(a), 4) + 0.0 AS slope, round(any_value(b), 4) + 0.0 AS intercept, count(*) AS n FROM samples, l GROUP BY 1")
def ratio(spark, sf):
    t = samples(spark, sf)
    line = profile.ratio_line(t, "quantity", "price").first()
    side = profile.ratio_side(t, "quantity", "price").groupBy("above_line").agg(F.count("*").alias("n"))
    return rounded(side.withColumn("slope", F.lit(line["slope"])).withColumn("intercept", F.lit(line["intercept"])), 4)


A14_SQL = f"""WITH {SAMPLES_SQL}, st AS (SELECT status, count(price) AS n, stddev_samp(price) * pow(count(price), -0.2) AS h, min(price) AS lo, max(price) AS hi FROM samples GROUP BY status),
 b AS (SELECT min(lo - 3 * h) AS lo, max(hi + 3 * h) AS hi FROM st),
 g AS (SELECT k::BIGINT AS grid, lo + k * (hi - lo) / 99 AS x FROM b, range(100) r(k))
 SELECT s.status, 'price' AS feature, grid, round(x, 4) + 0.0 AS x, round(1e6 * sum(exp(-pow((x - price) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) + 0.0 AS density
 FROM samples s JOIN st USING (status), g GROUP BY s.status, grid, x"""


@query("a14_kernel_density", A14_SQL)
def kde(spark, sf):
    out = profile.kernel_density(samples(spark, sf), ["price"], "status", grid_size=100)
    return rounded(out.withColumn("density", F.col("density") * 1e6), {"x": 4, "density": 6})


A15_SQL = f"""WITH {vectors_sql(2)}, s AS (SELECT count(*) AS n, min(x0) AS a0, max(x0) AS a1, min(x1) AS b0, max(x1) AS b1, var_samp(x0) AS vx, var_samp(x1) AS vy, covar_samp(x0, x1) AS vxy FROM vectors),
 k AS (SELECT *, pow(n, 1.0 / 3) * vy / (vx * vy - vxy * vxy) AS ix, pow(n, 1.0 / 3) * vx / (vx * vy - vxy * vxy) AS iy, -pow(n, 1.0 / 3) * vxy / (vx * vy - vxy * vxy) AS ixy, 0.05 * greatest(a1 - a0, b1 - b0) AS e FROM s),
 g AS (SELECT i::BIGINT AS i, j::BIGINT AS j, a0 - e + i * (a1 - a0 + 2 * e) / 99 AS x, b0 - e + j * (b1 - b0 + 2 * e) / 99 AS y, k.* FROM k, range(100) r(i), range(100) q(j))
 SELECT i, j, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(sum(exp(-0.5 * (ix * (x - x0) * (x - x0) + 2 * ixy * (x - x0) * (y - x1) + iy * (y - x1) * (y - x1)))) * sqrt(any_value(ix * iy - ixy * ixy)) / (2 * pi() * any_value(n)), 6) + 0.0 AS density
 FROM g, vectors GROUP BY i, j, x, y"""


@query("a15_density_grid", A15_SQL)
def kde2(spark, sf):
    return rounded(profile.density_grid(vectors(spark, sf, 2), "x0", "x1", size=100))


@query("a16_map_tiles", f"WITH {GEO_SQL} SELECT floor(longitude / 45)::BIGINT AS tile_lon, floor(latitude / 45)::BIGINT AS tile_lat, count(*) AS n, round(avg(probability), 8) + 0.0 AS mean_value FROM geo GROUP BY 1, 2")
def tiles(spark, sf):
    return rounded(profile.map_tiles(geo(spark, sf), "latitude", "longitude", "probability"), 8)


# ---------------------------------------------------------------- missing values
def _impute_sql(fill: str) -> str:
    return f"WITH {SAMPLES_SQL}, f AS (SELECT {fill.format('discount')} AS fd, {fill.format('tax')} AS ft FROM samples) SELECT flag, round(sum(coalesce(discount, fd)), 5) + 0.0 AS discount, round(sum(coalesce(tax, ft)), 5) + 0.0 AS tax, count(*) AS n FROM samples, f GROUP BY flag"


def _impute(spark, sf, method, value=None):
    t = samples(spark, sf)
    filled = missing.fit_imputer(t, ["discount", "tax"], method, value).transform(t)
    return rounded(filled.groupBy("flag").agg(F.sum("discount").alias("discount"), F.sum("tax").alias("tax"), F.count("*").alias("n")), 5)


@query("m1_impute_mean", _impute_sql("avg({})"))
def impute_mean(spark, sf):
    return _impute(spark, sf, "mean")


@query("m2_impute_median", _impute_sql("quantile_cont({}, 0.5)"))
def impute_median(spark, sf):
    return _impute(spark, sf, "median")


@query("m3_impute_most_frequent", f"WITH {SAMPLES_SQL}, d AS (SELECT discount AS v FROM samples WHERE discount IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), t AS (SELECT tax AS v FROM samples WHERE tax IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT flag, round(sum(coalesce(discount, d.v)), 5) + 0.0 AS discount, round(sum(coalesce(tax, t.v)), 5) + 0.0 AS tax, count(*) AS n FROM samples, d, t GROUP BY flag")
def impute_mode(spark, sf):
    return _impute(spark, sf, "most_frequent")


@query("m4_impute_constant", _impute_sql("0.5 + 0 * avg({})"))
def impute_constant(spark, sf):
    return _impute(spark, sf, "constant", 0.5)


def _kruskal_sql(inner: str, groups: str = "") -> str:
    """``inner`` yields (groups), v, a, b: counts of both groups per distinct value."""
    by = f"PARTITION BY {groups}" if groups else ""
    head = f"{groups}, " if groups else ""
    tail = normal_tail_sql("sqrt(greatest(h, 0))")
    return f"""SELECT {head}na, nb, h, least(1.0, 2 * {tail}) AS p FROM (
 SELECT {head}na, nb, (12.0 / (n * (n + 1)) * (ra * ra / na + rb * rb / nb) - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h FROM (
 SELECT {head}sum(a) AS na, sum(b) AS nb, sum(a + b)::DOUBLE AS n, sum(a * mid) AS ra, sum(b * mid) AS rb, sum(pow(a + b, 3) - (a + b)) AS tie FROM (
 SELECT *, coalesce(sum(a + b) OVER ({by} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + (a + b + 1) / 2.0 AS mid FROM ({inner}))
 {f'GROUP BY {groups}' if groups else ''}))"""


_FILLED = "filled AS (SELECT row_id, discount, coalesce(discount, (SELECT avg(discount) FROM samples)) AS whole FROM samples)"


@query("m5_kruskal_test", f"WITH {SAMPLES_SQL}, {_FILLED} SELECT 'discount' AS feature, na::BIGINT AS n_original, nb::BIGINT AS n_imputed, round(h, 6) + 0.0 AS statistic, round(p, 8) + 0.0 AS p_value FROM (" + _kruskal_sql("SELECT whole AS v, count(discount) AS a, count(*) AS b FROM filled GROUP BY 1") + ")")
def kruskal(spark, sf):
    t = samples(spark, sf)
    filled = missing.fit_imputer(t.select(c("discount").alias("full")), ["full"], "mean").transform(t.withColumn("full", c("discount")))
    return rounded(missing.kruskal_columns(filled, {"discount": "full"}), {"statistic": 6, "p_value": 8})


@query("m6_signed_rank_test", f"""WITH {SAMPLES_SQL}, d AS (SELECT round(full_discount - full_tax, 6) AS d FROM samples WHERE full_discount <> full_tax),
 g AS (SELECT abs(d) AS v, count(*) AS n, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS up FROM d GROUP BY 1),
 r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + (n + 1) / 2.0 AS mid FROM g),
 s AS (SELECT sum(n)::DOUBLE AS n, least(sum(up * mid), sum((n - up) * mid)) AS w, sum(pow(n, 3) - n) AS tie FROM r)
 SELECT n::BIGINT AS n, round(w, 1) + 0.0 AS statistic, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) + 0.0 AS z FROM s""")
def signed_rank(spark, sf):
    t = samples(spark, sf).select(F.round(F.col("full_discount") - F.col("full_tax"), 6).alias("a"), F.lit(0.0).alias("b"))
    return rounded(missing.signed_rank_test(t, "a", "b").select("n", "statistic", "z"), {"statistic": 1, "z": 6})


_BIT = "((strpos('0123456789abcdef', substr(md5('2-0-' || row_id), (i // 4 + 1)::BIGINT, 1)) - 1) >> (i % 4)::INTEGER) & 1"


@query("m7_monte_carlo_test", f"WITH {SAMPLES_SQL}, {_FILLED}, bits AS (SELECT i, whole AS v, sum(CASE WHEN discount IS NOT NULL THEN {_BIT} ELSE 0 END)::BIGINT AS a, sum({_BIT})::BIGINT AS b FROM filled, range(100) t(i) GROUP BY 1, 2) SELECT 'discount' AS feature, count(p) AS iterations, round(avg(p), 8) + 0.0 AS mean_p, avg(p) > 0 AND avg(p) < 0.05 AS rejected FROM (" + _kruskal_sql("SELECT * FROM bits", "i") + ")")
def monte_carlo(spark, sf):
    t = samples(spark, sf).withColumn("full", c("discount"))
    filled = missing.fit_imputer(t, ["full"], "mean").transform(t)
    out = missing.monte_carlo_rank_test(filled, "row_id", {"discount": "full"}, iterations=100)
    return rounded(out, {"mean_p": 8})


# ---------------------------------------------------------------- formulas
@query("f1_arithmetic", f"WITH {SAMPLES_SQL} SELECT row_id, round((price - quantity * 2) / nullif(full_discount, 0) + -quantity, 4) + 0.0 AS ratio FROM samples")
def arithmetic(spark, sf):
    t = samples(spark, sf)
    return rounded(fit_formulas(t, {"ratio": "(price - quantity * 2) / full_discount + -quantity"}).transform(t).select("row_id", "ratio"), 4)


@query("f2_to_f5_functions", f"WITH {SAMPLES_SQL} SELECT row_id, round(pow(quantity, 0.5), 6) + 0.0 AS root, round(sin(quantity) + cos(price * pi()), 4) + 0.0 AS wave, round(tan(full_tax), 6) + 0.0 AS slope, round(CASE WHEN full_discount > 0 THEN ln(full_discount) END, 6) + 0.0 AS logd FROM samples")
def functions(spark, sf):
    t = samples(spark, sf)
    model = fit_formulas(t, {"root": "pow(quantity, 0.5)", "wave": "sin(quantity) + cos(price * pi)", "slope": "tan(full_tax)", "logd": "log(full_discount)"})
    return rounded(model.transform(t).select("row_id", "root", "wave", "slope", "logd"), {"wave": 4})


@query("f6_f7_whole_column", f"WITH {SAMPLES_SQL}, g AS (SELECT avg(price) AS m, stddev_pop(price) AS s, var_pop(tax) AS v FROM samples) SELECT row_id, round((price - m) / s, 6) + 0.0 AS z, round(v * quantity, 8) + 0.0 AS spread FROM samples, g")
def whole_column(spark, sf):
    t = samples(spark, sf)
    model = fit_formulas(t, {"z": "(price - mean(price)) / std(price)", "spread": "var(tax) * quantity"})
    return rounded(model.transform(t).select("row_id", "z", "spread"), {"z": 6, "spread": 8})


@query("f8_chained_columns", f"WITH {SAMPLES_SQL}, a AS (SELECT row_id, price / quantity AS unit FROM samples), g AS (SELECT avg(unit) AS m FROM a) SELECT row_id, round(unit, 9) + 0.0 AS unit, round(m, 6) + 0.0 AS level, round(unit - m, 6) + 0.0 AS dev FROM a, g")
def chained(spark, sf):
    t = samples(spark, sf)
    model = fit_formulas(t, {"unit": "price / quantity", "level": "mean(unit)", "dev": "unit - level"})
    return rounded(model.transform(t).select("row_id", "unit", "level", "dev"), {"unit": 9})


@query("f9_replay_formulas", f"WITH {SAMPLES_SQL}, a AS (SELECT *, {hash_uniform_sql('app', 'row_id')} >= 0.9 AS app FROM samples), g AS (SELECT avg(price) AS m FROM a WHERE NOT app), h AS (SELECT avg(price) AS m2 FROM a WHERE app) SELECT row_id, round(price - m, 4) + 0.0 AS dev, round(price - m2, 4) + 0.0 AS own_dev FROM a, g, h WHERE app")
def replay(spark, sf):
    from assaykit.table import hash_uniform

    t = samples(spark, sf).withColumn("app", hash_uniform("app", "row_id") >= 0.9)
    train, app = t.filter("not app"), t.filter("app")
    model = fit_formulas(train, {"dev": "price - mean(price)"})
    again = model.recompute(app).select("row_id", F.col("dev").alias("own_dev"))
    return rounded(model.transform(app).select("row_id", "dev").join(again, "row_id"), 4)


@query("f10_formula_checks", "SELECT 'unknown column' AS problem, count(*) AS n FROM part UNION ALL SELECT 'target used', count(*) FROM part UNION ALL SELECT 'power sign', count(*) FROM part UNION ALL SELECT 'no column', count(*) FROM part UNION ALL SELECT 'arity', count(*) FROM part")
def formula_checks(spark, sf):
    from assaykit.functions.formula import FormulaError

    t = read_table(spark, sf, "part")
    cases = {"unknown column": "nope + 1", "target used": "p_retailprice * 2", "power sign": "p_size ^ 2", "no column": "1 + pi", "arity": "pow(p_size)"}
    out = None
    for name, text in cases.items():
        try:
            fit_formulas(t, {"f": text}, targets=["p_retailprice"])
        except FormulaError:
            one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
            out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- preparation
def _scale_sql(expr: str) -> str:
    return f"WITH {SAMPLES_SQL}, g AS (SELECT min(price) AS lo, max(price) AS hi, avg(price) AS m, stddev_pop(price) AS s FROM samples) SELECT row_id, round({expr}, 8) + 0.0 AS price FROM samples, g"


def _scale(spark, sf, method, **kw):
    t = samples(spark, sf)
    return rounded(scaling.fit_scaler(t, ["price"], method, **kw).transform(t).select("row_id", "price"), 8)


@query("s1_minmax", _scale_sql("(price - lo) / (hi - lo)"))
def minmax(spark, sf):
    return _scale(spark, sf, "minmax")


@query("s2_standardize", _scale_sql("(price - m) / s"))
def standardize(spark, sf):
    return _scale(spark, sf, "standardize")


@query("s3_mean_normalization", f"WITH {SAMPLES_SQL}, g AS (SELECT min(price) AS lo, max(price) AS hi, avg(price) AS m, stddev_pop(price) AS s FROM samples) SELECT row_id, round((price - m) / (hi - lo), 8) + 0.0 AS by_range, round((price - m) / s, 8) + 0.0 AS by_std, round(price, 4) + 0.0 AS back FROM samples, g")
def mean_normal(spark, sf):
    t = samples(spark, sf)
    model = scaling.fit_scaler(t, ["price"], "mean_normalization")
    compat = scaling.fit_scaler(t, ["by_std"] if "by_std" in t.columns else ["price"], "mean_normalization", compat_std=True)
    scaled = model.transform(t)
    out = scaled.select("row_id", F.col("price").alias("by_range")).join(model.inverse(scaled).select("row_id", F.col("price").alias("back")), "row_id")
    out = out.join(compat.transform(t).select("row_id", F.col("price").alias("by_std")), "row_id")
    return rounded(out, {"by_range": 8, "by_std": 8, "back": 4})


@query("s4_f_regression", f"WITH {SAMPLES_SQL} " + union_all([f"SELECT '{n}' AS feature, round(r * r / (1 - r * r) * (n - 2), 4) + 0.0 AS score FROM (SELECT corr({n}, price) AS r, regr_count(price, {n}) AS n FROM samples)" for n in ("quantity", "full_discount", "full_tax")]))
def f_reg(spark, sf):
    return rounded(selection.f_regression(samples(spark, sf), ["quantity", "full_discount", "full_tax"], "price"), 4)


def _anova_sql(n: str) -> str:
    return f"""SELECT '{n}' AS feature, round((ssb / (k - 1)) / (ssw / (n - k)), 6) + 0.0 AS score FROM (
 SELECT sum(c * (m - gm) * (m - gm)) AS ssb, sum(c * v) AS ssw, sum(c) AS n, count(*) AS k FROM (
 SELECT flag, count({n}) AS c, avg({n}) AS m, var_pop({n}) AS v FROM samples GROUP BY flag), (SELECT avg({n}) AS gm FROM samples))"""


@query("s5_anova_f", f"WITH {SAMPLES_SQL} " + union_all([_anova_sql(n) for n in SAMPLE_FEATURES]))
def anova(spark, sf):
    return rounded(selection.anova_f(samples(spark, sf), SAMPLE_FEATURES, "flag"))


@query("s6_select_k_best", f"WITH {SAMPLES_SQL} SELECT row_id, quantity FROM samples")
def k_best(spark, sf):
    t = samples(spark, sf)
    chosen = selection.select_k_best(t, ["full_tax", "quantity"], "price", 1, "regression")
    return rounded(t.select("row_id", *chosen))


@query("s7_multi_target_keeps_all", f"WITH {SAMPLES_SQL} SELECT row_id, quantity, full_tax FROM samples")
def multi_select(spark, sf):
    t = samples(spark, sf)
    return rounded(t.select("row_id", *selection.select_for_targets(t, ["quantity", "full_tax"], ["price", "full_discount"], 1, "regression")))


@query("s8_polynomial_features", f"""WITH {SAMPLES_SQL} SELECT row_id, 1.0::DOUBLE AS "1", quantity, round(full_discount, 8) + 0.0 AS full_discount, quantity * quantity AS "quantity^2", round(quantity * full_discount, 8) + 0.0 AS "quantity full_discount", round(full_discount * full_discount, 8) + 0.0 AS "full_discount^2" FROM samples""")
def poly(spark, sf):
    return rounded(polynomial_features(samples(spark, sf), ["quantity", "full_discount"], 2, keep=["row_id"]), 8)


@query("s9_random_split", f"WITH {SAMPLES_SQL}, u AS (SELECT row_id, {hash_uniform_sql(42, 'row_id')} AS u FROM samples) SELECT row_id, CASE WHEN row_number() OVER (ORDER BY u) <= ceil((SELECT count(*) FROM u) * 0.2) THEN 'test' ELSE 'train' END AS split FROM u")
def rand_split(spark, sf):
    return split.random_split(samples(spark, sf), "row_id", 0.2, 42, exact=True).select("row_id", "split")


@query("s10_stratified_split", f"WITH u AS (SELECT vec_id, label::BIGINT AS label, {hash_uniform_sql(42, 'vec_id')} AS u FROM embeddings) SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY u) <= ceil(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split FROM u")
def strat_split(spark, sf):
    t = vectors(spark, sf, 1)
    return split.stratified_split(t, "vec_id", "label").select("vec_id", "label", "split")


@query("s11_over_sample", f"WITH {SAMPLES_SQL}, m AS (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM samples GROUP BY flag)), u AS (SELECT row_id, flag, row_number() OVER (PARTITION BY flag ORDER BY {hash_uniform_sql(42, 'row_id')}) AS r, count(*) OVER (PARTITION BY flag) AS n FROM samples) SELECT row_id, flag, (top // n + CASE WHEN r <= top % n THEN 1 ELSE 0 END)::BIGINT AS copies FROM u, m")
def over(spark, sf):
    return split.over_sample(samples(spark, sf), "row_id", "flag").groupBy("row_id", "flag").agg(F.count("*").alias("copies"))


@query("s12_under_sample", f"WITH {SAMPLES_SQL}, m AS (SELECT min(n) AS low FROM (SELECT count(*) AS n FROM samples GROUP BY flag)), u AS (SELECT row_id, flag, row_number() OVER (PARTITION BY flag ORDER BY {hash_uniform_sql(42, 'row_id')}) AS r FROM samples) SELECT row_id, flag FROM u, m WHERE r <= low")
def under(spark, sf):
    return split.under_sample(samples(spark, sf), "row_id", "flag").select("row_id", "flag")


@query("s13_over_then_under", f"WITH {SAMPLES_SQL}, c AS (SELECT flag, count(*) AS n FROM samples GROUP BY flag) SELECT flag, (SELECT max(n) FROM c) AS n FROM c")
def over_under(spark, sf):
    return split.over_then_under_sample(samples(spark, sf), "row_id", "flag").groupBy("flag").agg(F.count("*").alias("n"))


@query("s14_first_seen_codes", "WITH f AS (SELECT o_orderpriority AS label, min(o_orderkey) AS f, count(*) AS n FROM orders GROUP BY 1) SELECT label, (row_number() OVER (ORDER BY f, label) - 1)::BIGINT AS code, n FROM f")
def first_codes(spark, sf):
    t = read_table(spark, sf, "orders")
    return rounded(labels.first_seen_labels(t, "o_orderpriority", "o_orderkey").mapping_table(t))


@query("s15_label_map", "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'mid' ELSE 'low' END AS label, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 2 END::BIGINT AS code, count(*) AS n FROM orders GROUP BY 1, 2")
def map_labels(spark, sf):
    t = read_table(spark, sf, "orders")
    return rounded(labels.mapped_labels(t, "o_orderpriority", J2_MAP).mapping_table(t))


@query("s16_interval_bins", "SELECT CASE WHEN o_totalprice <= 150000 THEN 0 WHEN o_totalprice <= 250000 THEN 1 ELSE 2 END::BIGINT AS code, count(*) AS n, round(max(o_totalprice), 2) + 0.0 AS top FROM orders GROUP BY 1")
def interval_bins(spark, sf):
    t = read_table(spark, sf, "orders")
    model = labels.interval_labels(t, "o_totalprice", [150000.0, 250000.0])
    return rounded(model.encode(t).groupBy("code").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")), 2)


@query("s17_quantile_bins", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS d FROM orders) SELECT CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 WHEN o_totalprice <= d THEN 2 ELSE 3 END::BIGINT AS code, count(*) AS n, round(max(o_totalprice), 2) + 0.0 AS top FROM orders, q GROUP BY 1")
def quantile_bins(spark, sf):
    t = read_table(spark, sf, "orders")
    model = labels.quantile_labels(t, "o_totalprice", 4)
    return rounded(model.encode(t).groupBy("code").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")), 2)


@query("s18_decoded_codes", "SELECT CASE o_orderstatus WHEN 'F' THEN 'F' ELSE o_orderstatus END AS decoded, count(*) AS n FROM orders GROUP BY 1")
def decoded(spark, sf):
    t = read_table(spark, sf, "orders")
    model = labels.sorted_labels(t, "o_orderstatus")
    return model.decode(model.encode(t), "code").groupBy("decoded").agg(F.count("*").alias("n"))


@query("s19_sorted_codes", "SELECT c_mktsegment AS label, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::BIGINT AS code, count(*) AS n FROM customer GROUP BY c_mktsegment")
def sorted_codes(spark, sf):
    t = read_table(spark, sf, "customer")
    return rounded(labels.sorted_labels(t, "c_mktsegment").mapping_table(t))


@query("s20_fitted_chain", f"WITH {SAMPLES_SQL}, f AS (SELECT avg(discount) AS fd, avg(tax) AS ft FROM samples), g AS (SELECT row_id, quantity, coalesce(discount, fd) AS discount, coalesce(tax, ft) AS tax FROM samples, f), s AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(discount) AS md, stddev_pop(discount) AS sd, avg(tax) AS mt, stddev_pop(tax) AS st FROM g) SELECT row_id, round((quantity - mq) / sq, 6) + 0.0 AS quantity, round((discount - md) / sd, 6) + 0.0 AS discount, round((tax - mt) / st, 6) + 0.0 AS tax FROM g, s")
def chain(spark, sf):
    from assaykit.plans.preparation import Preparation

    t = samples(spark, sf)
    prep = Preparation(("quantity", "discount", "tax"), impute="mean", scale="standardize").fit(t)
    return rounded(prep.transform(t).select("row_id", "quantity", "discount", "tax"))
