"""Sampling and splitting queries (A1-A10, G1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import sampling as S
from corpusflow.plans.registry import query
from corpusflow.plans.sqlparts import quota_cte, sql_order, sql_uniform
from corpusflow.sources.tables import Tables

SEED = 42


def labelled_docs(t: Tables):
    """documents joined to their quality label: (doc_id, source, lang, label)."""
    return (t.documents.select("doc_id", "source", "lang")
            .join(t.labels.select("doc_id", F.col("quality").alias("label")), "doc_id"))


LABELLED_SQL = "SELECT d.doc_id, d.source, d.lang, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


@query("few_shot", f"""
SELECT doc_id, label, rank FROM (
  SELECT doc_id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {sql_order(SEED, 'doc_id')}, doc_id) AS rank
  FROM ({LABELLED_SQL})) WHERE rank <= 16""")
def few_shot(spark, d):
    df = labelled_docs(Tables(spark, d))
    return S.few_shot(df, 16, "label", SEED, "doc_id").select("doc_id", "label", "rank")


@query("few_shot_embeddings", f"""
SELECT vec_id, label, rank FROM (
  SELECT vec_id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {sql_order(SEED, 'vec_id')}, vec_id) AS rank
  FROM embeddings) WHERE rank <= 8""")
def few_shot_embeddings(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", "label")
    return S.few_shot(e, 8, "label", SEED, "vec_id").select("vec_id", "label", "rank")


@query("sample_exact", f"""
SELECT doc_id, rank FROM (
  SELECT doc_id, ROW_NUMBER() OVER (ORDER BY {sql_order(SEED, 'doc_id')}, doc_id) AS rank FROM documents)
WHERE rank <= 300""")
def sample_exact(spark, d):
    return S.sample_exact(Tables(spark, d).documents.select("doc_id"), 300, SEED, "doc_id")


@query("few_shot_reduction", f"""
WITH s AS (SELECT * FROM (
  SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {sql_order(SEED, 'doc_id')}, doc_id) AS rank
  FROM ({LABELLED_SQL})) WHERE rank <= 32)
SELECT o.orig_rows, s.sampled_rows, ROUND(o.orig_rows / s.sampled_rows, 6) AS reduction
FROM (SELECT COUNT(*) AS orig_rows FROM ({LABELLED_SQL})) o, (SELECT COUNT(*) AS sampled_rows FROM s) s""")
def few_shot_reduction(spark, d):
    df = labelled_docs(Tables(spark, d))
    r = S.reduction(df, S.few_shot(df, 32, "label", SEED, "doc_id"))
    return r.withColumn("reduction", F.round("reduction", 6))


def _split_sql(frac_sql: str, held: str, kept: str = "train", src: str = LABELLED_SQL) -> str:
    return f"""
WITH base AS ({src}),
cc AS (SELECT label, COUNT(*) AS c FROM base GROUP BY label),
{quota_cte('q', 'cc', 'label', 'c', frac_sql)},
r AS (SELECT doc_id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {sql_order(SEED, 'doc_id')}, doc_id) AS rn FROM base)
SELECT r.doc_id, r.label, CASE WHEN r.rn <= q.quota THEN '{held}' ELSE '{kept}' END AS split
FROM r JOIN q ON r.label = q.label"""


@query("stratified_split_2way", _split_sql("0.1", "validation"))
def stratified_split_2way(spark, d):
    df = labelled_docs(Tables(spark, d)).select("doc_id", "label")
    return S.stratified_split(df, "label", 0.1, SEED, "doc_id", held="validation").select("doc_id", "label", "split")


SPLIT3_SQL = f"""
WITH base AS ({LABELLED_SQL}),
cc AS (SELECT label, COUNT(*) AS c FROM base GROUP BY label),
{quota_cte('q1', 'cc', 'label', 'c', '0.1 + 0.1')},
{quota_cte('q2', 'q1', 'label', 'quota', '1 - 0.1 / (0.1 + 0.1)')},
r AS (SELECT doc_id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {sql_order(SEED, 'doc_id')}, doc_id) AS rn FROM base)
SELECT r.doc_id, r.label,
       CASE WHEN r.rn <= q2.quota THEN 'test' WHEN r.rn <= q1.quota THEN 'validation' ELSE 'train' END AS split
FROM r JOIN q1 ON r.label = q1.label JOIN q2 ON r.label = q2.label"""


@query("stratified_split_3way", SPLIT3_SQL)
def stratified_split_3way(spark, d):
    df = labelled_docs(Tables(spark, d)).select("doc_id", "label")
    return S.stratified_split3(df, "label", 0.1, 0.1, SEED, "doc_id").select("doc_id", "label", "split")


@query("label_distribution", f"""
SELECT split, label, COUNT(*) AS n_rows,
       ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY split), 6) AS share
FROM ({SPLIT3_SQL}) GROUP BY split, label""")
def label_distribution(spark, d):
    from corpusflow.operators.profile import label_distribution as ld
    df = labelled_docs(Tables(spark, d)).select("doc_id", "label")
    sp = S.stratified_split3(df, "label", 0.1, 0.1, SEED, "doc_id")
    return ld(sp, "split", "label").withColumn("share", F.round("share", 6))


# documents whose source is src0/src1 form an existing test split; the rest is train
def _with_split(t: Tables):
    df = labelled_docs(t)
    return df.withColumn("split", F.when(F.col("source").isin("src0", "src1"), "test").otherwise("train"))


@query("ensure_splits_existing", f"""
WITH base0 AS (SELECT doc_id, label, CASE WHEN source IN ('src0', 'src1') THEN 'test' ELSE 'train' END AS split
               FROM ({LABELLED_SQL})),
made AS ({_split_sql('0.1', 'validation', src="SELECT doc_id, label FROM base0 WHERE split = 'train'")})
SELECT doc_id, label, split FROM made
UNION ALL SELECT doc_id, label, split FROM base0 WHERE split <> 'train'""")
def ensure_splits_existing(spark, d):
    df = _with_split(Tables(spark, d)).select("doc_id", "label", "split")
    return S.ensure_splits(df, "label", 0.1, 0.1, SEED, "doc_id").select("doc_id", "label", "split")


SHOTS = [8, 16, 32, 64, 128]


@query("few_shot_curve", f"""
SELECT s.n_shots, r.doc_id, r.label FROM (
  SELECT doc_id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {sql_order(SEED, 'doc_id')}, doc_id) AS rn
  FROM ({LABELLED_SQL})) r
JOIN (SELECT UNNEST([{', '.join(map(str, SHOTS))}]) AS n_shots) s ON r.rn <= s.n_shots""")
def few_shot_curve(spark, d):
    df = labelled_docs(Tables(spark, d))
    return S.few_shot_curve(df, SHOTS, "label", SEED, "doc_id").select("n_shots", "doc_id", "label")


@query("seeded_replicates", """
SELECT seed, doc_id, label, rank FROM (
  SELECT s.seed, b.doc_id, b.label,
         ROW_NUMBER() OVER (PARTITION BY s.seed, b.label
                            ORDER BY md5(CAST(s.seed AS VARCHAR) || '|' || CAST(b.doc_id AS VARCHAR)), b.doc_id) AS rank
  FROM (""" + LABELLED_SQL + """) b CROSS JOIN (SELECT UNNEST([1, 2, 3]) AS seed) s) WHERE rank <= 8""")
def seeded_replicates(spark, d):
    df = labelled_docs(Tables(spark, d)).select("doc_id", "label")
    return S.replicate(df, [1, 2, 3], 8, "label", "doc_id").select("seed", "doc_id", "label", "rank")


@query("assign_batches", f"""
SELECT batch_id, COUNT(*) AS n_rows, MIN_BY(vec_id, rn) AS first_vec_id FROM (
  SELECT vec_id, ROW_NUMBER() OVER (ORDER BY {sql_order(SEED, 'vec_id')}, vec_id) AS rn,
         CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY {sql_order(SEED, 'vec_id')}, vec_id) - 1) / 8) AS BIGINT) AS batch_id
  FROM embeddings) GROUP BY batch_id""")
def assign_batches(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id")
    b = S.assign_batches(e, 8, SEED, "vec_id")
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.min_by("vec_id", "sample_rank").alias("first_vec_id"))


def _poisson_case(u_sql: str, lam: float) -> str:
    # copies = number of points of the cumulative Poisson probabilities that are <= u
    terms = f"list_transform(range(0, 20), lambda i: exp(-{lam}) * pow({lam}, i) / factorial(i::INTEGER))"
    return f"(len(list_filter(list_transform(range(1, 21), lambda k: list_sum(list_slice({terms}, 1, k))), lambda c: c <= {u_sql})))"


@query("bootstrap_split", f"""
SELECT doc_id, replica FROM (
  SELECT doc_id, {_poisson_case(sql_uniform(SEED, 'doc_id'), 0.2)} AS k FROM documents) x,
  LATERAL (SELECT UNNEST(range(1, k + 1)) AS replica) WHERE k > 0""")
def bootstrap_split(spark, d):
    df = Tables(spark, d).documents.select("doc_id")
    return S.bootstrap(df, 0.2, SEED, "doc_id").select("doc_id", F.col("replica").cast("bigint").alias("replica"))


@query("bootstrap_exact", f"""
WITH n AS (SELECT COUNT(*) AS n_all FROM documents),
r AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY md5('{SEED}|' || CAST(doc_id AS VARCHAR)), doc_id) AS pos FROM documents),
d AS (SELECT 1 + CAST(FLOOR(('0x' || substr(md5('{SEED}|draw|' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * n_all::DOUBLE) AS BIGINT) AS pos
      FROM n, range(0, n_all // 5) t(i))
SELECT doc_id, COUNT(*) AS times FROM d JOIN r USING (pos) GROUP BY doc_id""")
def bootstrap_exact(spark, d):
    """A fifth of the documents, drawn with replacement: the draws add up to that number exactly."""
    df = Tables(spark, d).documents.select("doc_id")
    return S.sample_with_replacement(df, df.count() // 5, SEED, "doc_id").select("doc_id", "times")
