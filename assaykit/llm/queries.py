"""Queries of the training-data operators and, where SQL can say it, the same rows as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import (
    centroids, chat_format, context_mixing, decontaminate, divergence, html_extract, line_dedup, packing, quality, secret_scan, simhash, spotsigs, toxicity,
)
from assaykit.table import hash_uniform_sql, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op2_line_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf, "documents"))
    return out.select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM s),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
hit AS (SELECT doc_id, dp.k, p, item_id FROM dp JOIN win ON dp.k = win.k AND array_to_string(w[p:p + dp.k - 1], ' ') = g),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


@query("op3_decontamination", OP3_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    out = decontaminate.contamination(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return quality.grade_documents(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _packing_sql() -> str:
    """The same programme, one level a table: the cheapest way to cut the first j lengths into b buckets, and the last cut."""
    top, b = packing.MAX_WORDS, packing.BUCKETS
    levels = ["l0 AS (SELECT 0 AS j, 0::BIGINT AS c, 0 AS i)"]
    for k in range(1, b + 1):
        levels.append(
            f"l{k} AS MATERIALIZED (SELECT j, m.c AS c, m.i AS i FROM (SELECT h.j, min(struct_pack(c := p.c + h.size * (h.r - g.r) - (h.t - g.t), i := p.j)) AS m "
            f"FROM h JOIN l{k - 1} p ON p.j < h.j JOIN g ON g.j = p.j GROUP BY h.j))"
        )
    cuts = [f"b{b} AS (SELECT max(j) AS j FROM h)"]
    for k in range(b, 1, -1):
        cuts.append(f"b{k - 1} AS (SELECT l{k}.i AS j FROM l{k} JOIN b{k} ON l{k}.j = b{k}.j)")
    bounds = " UNION ALL ".join(f"SELECT j FROM b{k}" for k in range(1, b + 1))
    u = hash_uniform_sql("pack", "doc_id", "piece")
    return f"""
WITH w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
p AS (SELECT doc_id, n, unnest(range(0, (n + {top - 1}) // {top})) AS piece FROM w WHERE n > 0),
q AS (SELECT doc_id, piece, piece * {top} AS start, least({top}, n - piece * {top}) AS length, {u} AS u FROM p),
s AS (SELECT length AS size, count(*) AS m FROM q GROUP BY 1),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY size)::INT AS j, size, (sum(m) OVER (ORDER BY size))::BIGINT AS r, (sum(m * size) OVER (ORDER BY size))::BIGINT AS t FROM s),
g AS (SELECT j, r, t FROM h UNION ALL SELECT 0, 0, 0),
{", ".join(levels)},
{", ".join(cuts)},
e AS (SELECT DISTINCT h.size AS bucket FROM h JOIN ({bounds}) x ON h.j = x.j),
a AS (SELECT q.*, (SELECT min(bucket) FROM e WHERE bucket >= q.length) AS bucket FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY u, doc_id, piece, length) - 1 AS place, {packing.BATCH_TOKENS} // bucket AS room FROM a)
SELECT doc_id, piece::BIGINT AS piece, start::BIGINT AS start, length::BIGINT AS length, bucket::BIGINT AS bucket, (place // room)::BIGINT AS batch, (place % room)::BIGINT AS slot FROM n
"""


@query("op9_packing", _packing_sql())
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read_table(spark, sf, "documents"))


@query("op1_secret_scan")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf, "documents"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.grade_documents(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


HARD_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for control in chat_format.CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


OP6_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS body,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
             sum({len(chat_format.OPEN) + len(chat_format.CLOSE) + 2} + length(replace({_escaped_sql("role")}, chr(10), '{chat_format.BREAK}')) + length({_escaped_sql("text")})) AS chars
      FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(body) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""


@query("op6_chat_formatting", OP6_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(HARD_TURNS, "conv_id long, turn long, role string, text string")
    out = chat_format.format_records(chat_format.conversation_records(rows.unionByName(hard), mixed=True))
    turns = chat_format.read_back(F.col("formatted"))
    out = out.select("conv_id", turns.alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted")
    body = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(body.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op8_html_extraction")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.main_text(read_table(spark, sf, "pages"))


@query("op10_document_fingerprints")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return spotsigs.compare_edits(read_table(spark, sf, "documents"))


@query("op11_lm_scoring")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return context_mixing.score_texts(read_table(spark, sf, "documents"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= {divergence.LEAST_DOCUMENTS}),
l AS (SELECT lang, sum(n) AS n, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(t.n) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
s AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
       (1 + ({divergence.UNIT}::HUGEINT * (coalesce(c.n, 0) + {divergence.SMOOTH})) // (coalesce(gn.n, 0) + {divergence.SMOOTH} * l.v))::BIGINT AS p,
       (1 + ({divergence.UNIT}::HUGEINT * (k.n + {divergence.SMOOTH})) // (l.n + {divergence.SMOOTH} * l.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM u)
WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""


@query("op12_source_divergence", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf, "documents"))


def _clustering_sql() -> str:
    """The rounds unrolled: an assignment and new centroids a table; sums and floors in whole numbers."""
    k, dims = centroids.CLUSTERS, centroids.DIMENSIONS
    out = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS x, "
        f"sha256(concat('{centroids.SEED}:', coalesce(vec_id::VARCHAR, ''))) AS h FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM v ORDER BY h, x LIMIT {k})",
    ]
    for i in range(centroids.ROUNDS + 1):
        d = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        out.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := {d}, c := c.c)) AS m FROM v, c{i} c GROUP BY r)")
        if i < centroids.ROUNDS:
            floor = "(s - ((s % n) + n) % n) // n"
            out.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(z.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT c, list({floor} ORDER BY j)::BIGINT[] AS x FROM "
                f"(SELECT a.m.c AS c, j, sum(v.x[j]) AS s, count(*) AS n FROM a{i} a JOIN v ON a.r = v.r, range(1, {dims + 1}) t(j) GROUP BY 1, 2) GROUP BY c) z ON z.c = c.c)"
            )
    n = centroids.ROUNDS
    return f"""WITH {", ".join(out)}
SELECT vec_id, a.m.c::INT AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia, (sum(a.m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{n} a JOIN v ON a.r = v.r JOIN c{n} c ON c.c = a.m.c"""


@query("op13_centroid_clustering", _clustering_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    out = centroids.cluster(read_table(spark, sf, "embeddings"))
    return out.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ",").cast("binary"), 256)).drop("centroid")
