"""Gradient, importance, projection and vector-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.hashing import sql_row_hash32, sql_sub_uniform
from corpusflow.functions.text import words
from corpusflow.operators.joins import keyed_bag_cosine
from corpusflow.operators import curriculum as C
from corpusflow.operators import matrix as N
from corpusflow.operators import noise as NZ
from corpusflow.operators.profile import array_stats, path_group_mean
from corpusflow.plans.q_eval import PROBE_SQL
from corpusflow.plans.registry import query
from corpusflow.sources.tables import Tables

SEED = 42
N_SAMPLES, BATCH = 1000, 8
RANK, EPS = 4, 1e-6

GRAD_SQL = f"""WITH {PROBE_SQL},
s AS (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY md5('{SEED}|' || CAST(vec_id AS VARCHAR)), vec_id) AS rn FROM embeddings),
b AS (SELECT vec_id, (rn - 1) // {BATCH} AS batch_id FROM s WHERE rn <= {N_SAMPLES}),
bs AS (SELECT batch_id, COUNT(*) AS nb FROM b GROUP BY batch_id),
x AS (SELECT en.vec_id, en.label, en.p, e.embedding, b.batch_id, bs.nb FROM en JOIN b ON en.vec_id = b.vec_id
      JOIN bs ON b.batch_id = bs.batch_id JOIN embeddings e ON e.vec_id = en.vec_id),
rk AS (SELECT x.*, UNNEST(range(len(p))) AS k, UNNEST(p) AS pk FROM x),
rj AS (SELECT rk.*, UNNEST(range(len(embedding))) AS j, CAST(UNNEST(embedding) AS DOUBLE) AS xj FROM rk),
g AS (SELECT k, j, SUM((pk - CASE WHEN cls.classes[k + 1] = label THEN 1.0 ELSE 0.0 END) * xj / nb) AS g FROM rj, cls GROUP BY k, j)"""


def scored(spark, d):
    e = Tables(spark, d).embeddings
    return N.batched_probe(e, "vec_id", "label", "embedding", N_SAMPLES, BATCH, SEED)


def gradient(spark, d):
    return N.accumulate_gradient(scored(spark, d), "embedding")


@query("gradient_accumulate", GRAD_SQL + " SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, ROUND(g, 6) AS g FROM g")
def gradient_accumulate(spark, d):
    return gradient(spark, d).select("k", "j", F.round("g", 6).alias("g"))


@query("batch_mean_loss", GRAD_SQL + """,
bl AS (SELECT x.batch_id, AVG(-ln(x.p[list_position(cls.classes, x.label)])) AS l FROM x, cls GROUP BY x.batch_id)
SELECT COUNT(*) AS n_batches, ROUND(AVG(l), 6) AS avg_loss FROM bl""")
def batch_mean_loss(spark, d):
    r = N.batch_mean_loss(scored(spark, d))
    return r.select("n_batches", F.round("avg_loss", 6).alias("avg_loss"))


def _importance(spark, d):
    e = Tables(spark, d).embeddings
    W = N.weights_long(C.centroid_matrix(e, "label", "embedding"))
    name = F.concat(F.lit("probe.block."), F.floor(F.col("k") / 2).cast("string"), F.lit(".class"),
                    F.col("k").cast("string"), F.lit(".weight"))
    return N.importance(W, gradient(spark, d), name)


IMP_SQL = GRAD_SQL + """,
w AS (SELECT cm.k AS k, UNNEST(range(len(cm.cv))) AS j, UNNEST(cm.cv) AS w FROM cm),
wk AS (SELECT k, ROW_NUMBER() OVER (ORDER BY k) - 1 AS kk FROM cm),
imp AS (SELECT g.k, AVG(abs(w.w) * abs(g.g)) AS importance FROM g JOIN wk ON g.k = wk.kk JOIN w ON w.k = wk.k AND w.j = g.j GROUP BY g.k)"""


@query("importance_scores", IMP_SQL + """
SELECT CAST(k AS INTEGER) AS k, 'probe.block.' || (k // 2) || '.class' || k || '.weight' AS name, ROUND(importance, 6) AS importance FROM imp""")
def importance_scores(spark, d):
    return _importance(spark, d).select("k", "name", F.round("importance", 6).alias("importance"))


@query("group_importance", IMP_SQL + """
SELECT 'layer_' || (k // 2) || '_class' || k AS group_key, ROUND(AVG(importance), 6) AS mean_score, COUNT(*) AS n_items
FROM imp GROUP BY 1""")
def group_importance(spark, d):
    g = path_group_mean(_importance(spark, d), "name", "importance")
    return g.select("group_key", F.round("mean_score", 6).alias("mean_score"), "n_items")


@query("low_rank_project", f"""
SELECT vec_id, CAST(c AS INTEGER) AS c, ROUND(-CAST(embedding[c + 1] AS DOUBLE) / (1 + {EPS}), 6) AS b
FROM embeddings, range(0, {RANK}) t(c)""")
def low_rank_project(spark, d):
    e = Tables(spark, d).embeddings
    A = N.unit_rows(RANK, 64)
    p = N.low_rank_project(e, "embedding", A, EPS)
    return p.select("vec_id", F.posexplode("B").alias("c", "b")).select("vec_id", "c", F.round("b", 6).alias("b"))


@query("approx_error", f"""
SELECT ROUND(sqrt(SUM(CASE WHEN j < {RANK} THEN pow(x * (1 - 1 / (1 + {EPS})), 2) ELSE x * x END)) / sqrt(SUM(x * x)), 6) AS rel_error
FROM (SELECT UNNEST(range(len(embedding))) AS j, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings)""")
def approx_error(spark, d):
    e = Tables(spark, d).embeddings
    A = N.unit_rows(RANK, 64)
    p = N.low_rank_project(e, "embedding", A, EPS)
    return N.approx_error(p, "embedding", "B", A).select(F.round("rel_error", 6).alias("rel_error"))


# Every label is a group with its own dense basis: even labels of rank 2, odd ones of rank 5.  The oracle
# inverts the Gram matrices by Gauss-Jordan steps, one pivot a recursion.
GROUP_SQL = f"""
WITH RECURSIVE sz AS (SELECT MAX(len(embedding)) AS dim FROM embeddings),
gr AS (SELECT DISTINCT label, 2 + 3 * (label % 2) AS r FROM embeddings),
cell AS (SELECT label, r, i, j, (2 * (('0x' || substr(md5('{SEED}|' || label || '|' || i || '|' || j), 1, 8))::BIGINT / 4294967296.0) - 1) / sqrt(dim) AS a
         FROM gr, sz, range(0, r) t(i), range(0, dim) u(j)),
arow AS (SELECT label, r, i, list(a ORDER BY j) AS a FROM cell GROUP BY label, r, i),
amat AS (SELECT label, r, list(a ORDER BY i) AS a FROM arow GROUP BY label, r),
gj AS (SELECT label, r, a, 0 AS step, list_transform(range(1, r + 1), lambda x: list_concat(
           list_transform(range(1, r + 1), lambda y: list_dot_product(a[x], a[y]) + CASE WHEN x = y THEN {EPS} ELSE 0 END),
           list_transform(range(1, r + 1), lambda y: CASE WHEN x = y THEN 1.0::DOUBLE ELSE 0 END))) AS m FROM amat
       UNION ALL
       SELECT label, r, a, step + 1, list_transform(range(1, r + 1), lambda x: list_transform(range(1, 2 * r + 1), lambda y:
           CASE WHEN x = step + 1 THEN m[step + 1][y] / m[step + 1][step + 1]
                ELSE m[x][y] - m[x][step + 1] * m[step + 1][y] / m[step + 1][step + 1] END)) FROM gj WHERE step < r),
inv AS (SELECT label, r, a, list_transform(m, lambda row: row[r + 1:2 * r]) AS g FROM gj WHERE step = r),
ga AS (SELECT vec_id, e.label, r, a, g, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings e JOIN inv USING (label)),
gv AS (SELECT *, list_transform(a, lambda row: list_dot_product(v, row)) AS va FROM ga),
pb AS (SELECT *, list_transform(g, lambda row: -list_dot_product(row, va)) AS b FROM gv)"""


def _projected(spark, d):
    e = Tables(spark, d).embeddings
    ranks = e.select("label").distinct().withColumn("rank", 2 + 3 * (F.col("label") % 2))
    width = e.select(F.max(F.size("embedding")).alias("w")).first()["w"]
    return N.project_groups(e, "label", "embedding", N.group_bases(ranks, "label", "rank", width, seed=SEED, eps=EPS))


@query("group_projection", GROUP_SQL + """
SELECT vec_id, label, CAST(c AS INTEGER) AS c, ROUND(b[c + 1], 6) AS b FROM pb, range(0, r) t(c)""")
def group_projection(spark, d):
    p = _projected(spark, d)
    return p.select("vec_id", "label", F.posexplode("B").alias("c", "b")).select("vec_id", "label", "c", F.round("b", 6).alias("b"))


@query("group_projection_error", GROUP_SQL + """
SELECT label, COUNT(*) AS n_rows, CAST(MAX(r) AS INTEGER) AS rank,
       ROUND(sqrt(SUM(list_sum(list_transform(range(1, len(v) + 1), lambda j: pow(v[j] + list_sum(list_transform(range(1, r + 1), lambda c: b[c] * a[c][j])), 2)))))
             / sqrt(SUM(list_dot_product(v, v))), 6) AS rel_error FROM pb GROUP BY label""")
def group_projection_error(spark, d):
    e = N.group_approx_error(_projected(spark, d), "label", "embedding")
    return e.select("label", "n_rows", "rank", F.round("rel_error", 6).alias("rel_error"))


@query("vector_state", """
WITH s AS (SELECT vec_id, label, AVG(x) AS m, STDDEV_SAMP(x) AS sd FROM (
             SELECT vec_id, label, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id, label),
c AS (SELECT label, CASE WHEN abs(m) < 1e-6 AND sd < 0.02 THEN 'random' WHEN abs(m) > 1e-4 OR sd > 0.05 THEN 'warm' ELSE 'unclear' END AS st FROM s)
SELECT label, COUNT(*) AS n, COUNT(*) FILTER (WHERE st = 'random') AS n_random, COUNT(*) FILTER (WHERE st = 'warm') AS n_warm,
       COUNT(*) FILTER (WHERE st = 'unclear') AS n_unclear,
       CASE WHEN COUNT(*) FILTER (WHERE st = 'random') > 0.5 * COUNT(*) THEN 'random'
            WHEN COUNT(*) FILTER (WHERE st = 'warm') > 0.5 * COUNT(*) THEN 'warm' ELSE 'mixed' END AS verdict
FROM c GROUP BY label""")
def vector_state(spark, d):
    e = Tables(spark, d).embeddings
    st = array_stats(F.col("embedding"))
    c = e.select("label", N.classify_vectors(st["mean"], st["std"]).alias("st"))
    g = c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("st") == "random").alias("n_random"),
                               F.count_if(F.col("st") == "warm").alias("n_warm"), F.count_if(F.col("st") == "unclear").alias("n_unclear"))
    return g.withColumn("verdict", N.majority_verdict(F.col("n_random"), F.col("n_warm"), F.col("n")))


@query("cosine_filter", r"""
WITH aug AS (SELECT doc_id, text, array_to_string(list_filter(regexp_extract_all(text, '[^ \t\n\r]+'),
               lambda w, i: """ + sql_sub_uniform(sql_row_hash32(SEED, 'doc_id'), 'i - 1') + r""" >= 0.1), ' ') AS text_out
             FROM documents),
a AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, UNNEST(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM aug) GROUP BY 1, 2),
b AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, UNNEST(regexp_extract_all(lower(text_out), '[\p{L}\p{N}_]+')) AS term FROM aug) GROUP BY 1, 2),
na AS (SELECT doc_id, sqrt(SUM(tf * tf)) AS n FROM a GROUP BY 1), nb AS (SELECT doc_id, sqrt(SUM(tf * tf)) AS n FROM b GROUP BY 1),
dt AS (SELECT a.doc_id, SUM(a.tf * b.tf) AS dp FROM a JOIN b ON a.doc_id = b.doc_id AND a.term = b.term GROUP BY 1),
cs AS (SELECT na.doc_id, COALESCE(dt.dp, 0) / (na.n * nb.n) AS cosine FROM na JOIN nb ON na.doc_id = nb.doc_id LEFT JOIN dt ON dt.doc_id = na.doc_id)
SELECT d.doc_id, ROUND(cs.cosine, 6) AS cosine, cs.cosine > 0.85 AS kept FROM documents d LEFT JOIN cs ON d.doc_id = cs.doc_id""")
def cosine_filter(spark, d):
    """Keep an augmented text iff its cosine to its own source > 0.85.

    The pair is (document, its augmentation), keyed by ``doc_id``: a join on
    the document key and the shared term, never a pairing of different
    documents (``keyed_bag_cosine``).
    """
    docs = Tables(spark, d).documents.select("doc_id", "text")
    aug = NZ.drop_words(docs, "text", "doc_id", 0.1, SEED)
    c = keyed_bag_cosine(aug, "doc_id", words(F.col("text")), words(F.col("text_out")), out="_c")
    c = docs.select("doc_id").join(c, "doc_id", "left")
    return c.select("doc_id", F.round("_c", 6).alias("cosine"), (F.col("_c") > 0.85).alias("kept"))
