"""Budgeted allocation over corpus sources (B1-B14, G13) and the flagship
``budgeted_mixture``.

Re-aim: groups = document sources, importance = mean label quality of the
source, one unit = ``UNIT_DOCS`` documents, budget = target corpus size in
documents.  The allocation then picks that many documents per source with the
seeded per-group rank (A2 style).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.hashing import hash_order
from corpusflow.operators import budget as B
from corpusflow.operators.ranks import bounded_broadcast, class_rank
from corpusflow.plans.registry import query
from corpusflow.sources.tables import Tables

SEED = 42
BASE, MIN_U, MAX_U = 8, 2, 62
UNIT_DOCS = 8
BUDGET = 1600
SWEEP = [800, 1600, 3200, 6400]
PARAM_UNIT = B.unit_cost(2, 768)  # cost of one unit in the parameter form
LAYERS = 6


def source_groups(t: Tables):
    """One row per source: pos (first doc id), importance score, documents."""
    j = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy("source").agg(F.min("doc_id").alias("pos"),
                                   F.coalesce(F.avg("quality"), F.lit(0.0)).alias("score"),
                                   F.count(F.lit(1)).alias("n_docs"))


def allocation(t: Tables, budget=BUDGET, scenario=()):
    g = source_groups(t)
    return B.allocate(g, score="score", pos="pos", base=BASE, min_units=MIN_U, max_units=MAX_U,
                      unit_cost=UNIT_DOCS, budget=budget, scenario=scenario)


GROUPS_SQL = """
g0 AS (SELECT d.source, MIN(d.doc_id) AS pos, COALESCE(AVG(l.quality), 0.0) AS score, COUNT(*) AS n_docs
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source),
g1 AS (SELECT *, CASE WHEN MAX(score) OVER () = MIN(score) OVER () THEN 1.0
                      ELSE 0.25 + 3.75 * ln(1 + 10 * (score - MIN(score) OVER ()) / (MAX(score) OVER () - MIN(score) OVER ())) / ln(11)
                 END AS norm FROM g0),
g2 AS (SELECT *, CAST(GREATEST(%(lo)d, LEAST(%(hi)d, FLOOR(%(base)d * norm))) AS INTEGER) AS units_initial FROM g1)""" % {
    "lo": MIN_U, "hi": MAX_U, "base": BASE}


def greedy_sql(budgets: list[int], u: int = UNIT_DOCS) -> str:
    """The greedy reduce / raise loops as recursive CTEs (one state per budget):
    an oracle independent of the closed form used on Spark."""
    bl = ", ".join(str(b) for b in budgets)
    return f"""WITH RECURSIVE {GROUPS_SQL},
init AS (SELECT b.budget, list(units_initial ORDER BY pos) AS r, list(source ORDER BY pos) AS src
         FROM g2, (SELECT UNNEST([{bl}]) AS budget) b GROUP BY b.budget),
red(budget, it, r) AS (SELECT budget, 0, r FROM init UNION ALL
  SELECT budget, it + 1, list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i = list_position(r, list_max(r)) THEN r[i] - 1 ELSE r[i] END)
  FROM red WHERE list_sum(r) * {u} > budget AND list_max(r) > {MIN_U} AND list_sum(r) * {u} - {u} >= budget * 0.97),
r1 AS (SELECT budget, arg_max(r, it) AS r FROM red GROUP BY budget),
ad(budget, it, r) AS (SELECT budget, 0, r FROM r1 UNION ALL
  SELECT budget, it + 1, list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i = list_position(r, list_min(r)) THEN r[i] + 1 ELSE r[i] END)
  FROM ad WHERE list_sum(r) * {u} + {u} <= budget * 1.03 AND list_min(r) < {MAX_U}),
fin AS (SELECT budget, arg_max(r, it) AS r FROM ad GROUP BY budget),
alloc AS (SELECT fin.budget, init.src[i] AS source, fin.r[i] AS units
          FROM fin JOIN init ON fin.budget = init.budget, range(1, len(init.src) + 1) t(i))"""


ALLOC_SQL = greedy_sql([BUDGET])


@query("normalize_importance", f"WITH {GROUPS_SQL} SELECT source, pos, ROUND(score, 6) AS score, ROUND(norm, 6) AS norm FROM g1")
def normalize_importance(spark, d):
    g = B.normalize_importance(source_groups(Tables(spark, d)), "score")
    return g.select("source", "pos", F.round("score", 6).alias("score"), F.round("norm", 6).alias("norm"))


@query("initial_allocation", f"WITH {GROUPS_SQL} SELECT source, units_initial FROM g2")
def initial_allocation(spark, d):
    g = B.initial_units(B.normalize_importance(source_groups(Tables(spark, d)), "score"), BASE, MIN_U, MAX_U)
    return g.select("source", "units_initial")


@query("budget_allocation", ALLOC_SQL + " SELECT source, CAST(units AS INTEGER) AS units FROM alloc")
def budget_allocation(spark, d):
    return allocation(Tables(spark, d)).select("source", "units")


@query("allocation_cost", ALLOC_SQL + f"""
SELECT source, CAST(units AS INTEGER) AS units, CAST(units * {UNIT_DOCS} AS BIGINT) AS cost,
       CAST(units * {PARAM_UNIT} * {LAYERS} AS BIGINT) AS cost_model FROM alloc""")
def allocation_cost(spark, d):
    a = allocation(Tables(spark, d))
    return a.select("source", "units", B.cost(F.col("units"), UNIT_DOCS).alias("cost"),
                    B.cost(F.col("units"), PARAM_UNIT, LAYERS).alias("cost_model"))


STATS_SQL = ALLOC_SQL + f""",
st AS (SELECT COUNT(*) AS n_groups, CAST(SUM(units * {UNIT_DOCS}) AS BIGINT) AS total_cost, MIN(units) AS min_units,
              MAX(units) AS max_units, AVG(units) AS mean_units, STDDEV_POP(units) AS std_units FROM alloc)"""


@query("allocation_stats", STATS_SQL + f"""
SELECT n_groups, total_cost, CAST(min_units AS INTEGER) AS min_units, CAST(max_units AS INTEGER) AS max_units,
       ROUND(mean_units, 6) AS mean_units, ROUND(std_units, 6) AS std_units, {BUDGET} AS budget,
       ROUND(total_cost / {BUDGET}, 6) AS usage FROM st""")
def allocation_stats(spark, d):
    s = B.allocation_stats(allocation(Tables(spark, d)), BUDGET, UNIT_DOCS)
    return s.select("n_groups", "total_cost", "min_units", "max_units", F.round("mean_units", 6).alias("mean_units"),
                    F.round("std_units", 6).alias("std_units"), "budget", F.round("usage", 6).alias("usage"))


@query("allocation_flags", STATS_SQL + f"""
SELECT total_cost, {BUDGET} AS budget, ROUND(total_cost / {BUDGET}, 6) AS usage,
       total_cost / {BUDGET} > 1.05 AS error_over, total_cost / {BUDGET} < 0.95 AS warn_under,
       std_units < 1.0 AS warn_low_variation FROM st""")
def allocation_flags(spark, d):
    f = B.verify_allocation(B.allocation_stats(allocation(Tables(spark, d)), BUDGET, UNIT_DOCS))
    return f.select("total_cost", "budget", F.round("usage", 6).alias("usage"), "error_over", "warn_under", "warn_low_variation")


@query("importance_rank_corr", ALLOC_SQL + """
SELECT ROUND(CORR(g0.score, alloc.units), 6) AS corr_score_units FROM alloc JOIN g0 ON alloc.source = g0.source""")
def importance_rank_corr(spark, d):
    a = allocation(Tables(spark, d))
    return a.agg(F.round(F.corr("score", F.col("units").cast("double")), 6).alias("corr_score_units"))


@query("budget_sweep", greedy_sql(SWEEP) + " SELECT CAST(budget AS INTEGER) AS budget, source, CAST(units AS INTEGER) AS units FROM alloc")
def budget_sweep(spark, d):
    t = Tables(spark, d)
    bud = spark.createDataFrame([(b,) for b in SWEEP], "budget int")
    # the budget list is a fixed parameter of a few rows; groups are per source
    g = source_groups(t).crossJoin(F.broadcast(bud))
    a = B.allocate(g, score="score", pos="pos", base=BASE, min_units=MIN_U, max_units=MAX_U,
                   unit_cost=UNIT_DOCS, budget="budget", scenario=["budget"])
    return a.select("budget", "source", "units")


def budgeted_mixture_df(spark, d):
    t = Tables(spark, d)
    a = allocation(t).select("source", (F.col("units") * UNIT_DOCS).cast("bigint").alias("quota"))
    # one row per source: broadcast after a size check, so documents are not shuffled on a hot source
    docs = t.documents.select("doc_id", "source").join(bounded_broadcast(a), "source")
    r = class_rank(docs, ["source"], hash_order(SEED, "doc_id"), "doc_id", limit_col="quota")
    return r.select("doc_id", "source", "rank")


@query("budgeted_mixture", ALLOC_SQL + f"""
SELECT doc_id, source, rank FROM (
  SELECT d.doc_id, d.source, a.units,
         ROW_NUMBER() OVER (PARTITION BY d.source ORDER BY md5('{SEED}|' || CAST(d.doc_id AS VARCHAR)), d.doc_id) AS rank
  FROM documents d JOIN alloc a ON d.source = a.source) WHERE rank <= units * {UNIT_DOCS}""")
def budgeted_mixture(spark, d):
    return budgeted_mixture_df(spark, d)


@query("applied_audit", ALLOC_SQL + f""",
mix AS (SELECT source, COUNT(*) AS n FROM (
  SELECT d.source, a.units, ROW_NUMBER() OVER (PARTITION BY d.source ORDER BY md5('{SEED}|' || CAST(d.doc_id AS VARCHAR)), d.doc_id) AS rank
  FROM documents d JOIN alloc a ON d.source = a.source) WHERE rank <= units * {UNIT_DOCS} GROUP BY source),
j AS (SELECT a.source, a.units, CAST(CEIL(m.n / {UNIT_DOCS}) AS INTEGER) AS applied_units FROM alloc a FULL JOIN mix m ON a.source = m.source)
SELECT COUNT(*) AS n_groups, CAST(MIN(units) AS INTEGER) AS expected_min, CAST(MAX(units) AS INTEGER) AS expected_max,
       MIN(applied_units) AS applied_min, MAX(applied_units) AS applied_max,
       COUNT(DISTINCT units) AS n_unique_expected, COUNT(DISTINCT applied_units) AS n_unique_applied,
       COUNT(*) FILTER (WHERE units IS DISTINCT FROM applied_units) AS n_mismatch,
       list_sort(list(DISTINCT units)) = list_sort(list(DISTINCT applied_units)) AS sets_equal,
       COUNT(DISTINCT applied_units) = 1 AS all_same_applied FROM j""")
def applied_audit(spark, d):
    t = Tables(spark, d)
    exp = allocation(t).select("source", "units")
    mix = budgeted_mixture_df(spark, d)
    app = mix.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / UNIT_DOCS).cast("int").alias("applied_units"))
    return B.applied_audit(exp, app, "source")


QUOTA_SQL = """
s AS (SELECT source, CAST(SUM(n_chars) AS BIGINT) AS used FROM documents GROUP BY source),
q AS (SELECT CAST(FLOOR(SUM(used) / COUNT(*)) AS BIGINT) AS quota FROM s)"""


def _source_chars(t: Tables):
    s = t.documents.groupBy("source").agg(F.sum("n_chars").alias("used"))
    q = s.agg(F.floor(F.sum("used") / F.count(F.lit(1))).cast("bigint").alias("quota"))
    return s.crossJoin(F.broadcast(q))  # q is a one-row aggregate


@query("budget_flags", f"""WITH {QUOTA_SQL}
SELECT s.source, s.used, q.quota, ROUND(s.used / q.quota * 100, 6) AS usage_pct, s.used > q.quota AS exceeded,
       s.used / q.quota < 0.9 AS note_under_90,
       CASE WHEN s.used / q.quota > 1.1 THEN 'over' WHEN s.used / q.quota < 0.9 THEN 'under' ELSE 'ok' END AS band_10,
       CASE WHEN s.used / q.quota > 5 THEN 'critical' WHEN s.used / q.quota > 1.2 THEN 'over'
            WHEN s.used / q.quota < 0.8 THEN 'under' ELSE 'ok' END AS band_20
FROM s, q""")
def budget_flags(spark, d):
    s = _source_chars(Tables(spark, d))
    f = B.budget_flags(F.col("used"), F.col("quota"))
    return s.select("source", "used", "quota", F.round(f["usage_pct"], 6).alias("usage_pct"),
                    *[f[k].alias(k) for k in ("exceeded", "note_under_90", "band_10", "band_20")])


@query("budget_report", f"""WITH {QUOTA_SQL},
u AS (SELECT d.source, SUM(CASE WHEN l.quality = 1 THEN d.n_chars END) AS u1,
             SUM(CASE WHEN l.doc_id IS NOT NULL THEN d.n_chars END) AS u2, SUM(d.n_chars) AS u3
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source)
SELECT u.source, q.quota AS target, CAST(COALESCE(u1, u2, u3) AS BIGINT) AS used,
       ROUND(COALESCE(u1, u2, u3) / q.quota * 100, 6) AS usage_pct,
       CAST(q.quota - COALESCE(u1, u2, u3) AS BIGINT) AS remaining, COALESCE(u1, u2, u3) <= q.quota AS within_budget
FROM u, q""")
def budget_report(spark, d):
    t = Tables(spark, d)
    q = _source_chars(t).select("quota").distinct()
    j = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", F.lit(True).alias("_l"), "quality"), "doc_id", "left")
    u = j.groupBy("source").agg(F.sum(F.when(F.col("quality") == 1, F.col("n_chars"))).alias("u1"),
                                F.sum(F.when(F.col("_l"), F.col("n_chars"))).alias("u2"),
                                F.sum("n_chars").alias("u3"))
    r = B.budget_report(F.col("quota"), F.col("u1"), F.col("u2"), F.col("u3"))
    return u.crossJoin(F.broadcast(q)).select("source", r["target"].alias("target"), r["used"].alias("used"),
                                 F.round(r["usage_pct"], 6).alias("usage_pct"), r["remaining"].alias("remaining"),
                                 r["within_budget"].alias("within_budget"))


@query("matching_configs", ALLOC_SQL + f""",
tg AS (SELECT source, CAST(units * {PARAM_UNIT} AS BIGINT) AS target FROM alloc),
grid AS (SELECT 'lora' AS method, CAST(r AS INTEGER) AS r, CAST(NULL AS INTEGER) AS rf, CAST(2 * r * 768 AS BIGINT) AS cost FROM range(1, 65) t(r)
         UNION ALL SELECT 'adapter', NULL, rf, CAST(2 * 768 * (768 // rf) AS BIGINT) FROM (SELECT UNNEST([2, 4, 8, 16, 32, 64]) AS rf)
         UNION ALL SELECT 'hybrid', CAST(r AS INTEGER), rf, CAST(2 * r * 768 + 2 * 768 * (768 // rf) AS BIGINT)
                   FROM range(1, 65) t(r), (SELECT UNNEST([2, 4, 8, 16, 32, 64]) AS rf))
SELECT tg.source, tg.target, grid.method, grid.r, grid.rf, grid.cost FROM tg JOIN grid ON abs(grid.cost / tg.target - 1) <= 0.05""")
def matching_configs(spark, d):
    a = allocation(Tables(spark, d)).select("source", B.cost(F.col("units"), PARAM_UNIT).alias("target"))
    grid = B.candidate_grid(spark, 768)
    m = B.matching_configs(a, "target", grid)
    return m.select("source", "target", "method", "r", "rf", "cost")


@query("issue_report", """
WITH f AS (SELECT (SELECT COUNT(*) FROM documents) AS n_docs, (SELECT COUNT(DISTINCT text) FROM documents) AS n_texts,
                  (SELECT COUNT(*) FROM documents WHERE n_chars < 20) AS n_short,
                  (SELECT COUNT(*) FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)) AS n_unlabelled,
                  (SELECT MIN(c) / SUM(c) FROM (SELECT COUNT(*) AS c FROM labels GROUP BY quality)) AS minority_share),
r AS (SELECT 1 AS issue_id, 'CRITICAL' AS severity, 'More than half of the documents are unlabelled' AS description,
             'HIGH - most of the corpus cannot be used for training' AS impact, n_unlabelled > 0.5 * n_docs AS fires FROM f
      UNION ALL SELECT 2, 'CRITICAL', 'Minority class below 20% of labelled rows', 'MEDIUM - metrics need class weighting', minority_share < 0.2 FROM f
      UNION ALL SELECT 3, 'MAJOR', 'Duplicate texts present', 'LOW - inflated counts and leakage across splits', n_docs > n_texts FROM f
      UNION ALL SELECT 4, 'MAJOR', 'Very short texts present', 'LOW - near-empty training rows', n_short > 0 FROM f)
SELECT issue_id, severity, description, impact FROM r WHERE fires""")
def issue_report(spark, d):
    t = Tables(spark, d)
    docs = t.documents
    lab_ids = t.labels.select("doc_id").distinct().withColumn("_l", F.lit(True))
    f = (docs.join(lab_ids, "doc_id", "left")
             .agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct(F.md5("text")).alias("n_texts"),
                  F.count_if(F.col("n_chars") < 20).alias("n_short"), F.count_if(F.col("_l").isNull()).alias("n_unlabelled")))
    cls = t.labels.groupBy("quality").agg(F.count(F.lit(1)).alias("c")).agg(
        (F.min("c") / F.sum("c")).alias("minority_share"))
    facts = f.crossJoin(F.broadcast(cls))  # two one-row aggregates
    rules = [
        (1, "CRITICAL", "More than half of the documents are unlabelled",
         "HIGH - most of the corpus cannot be used for training", F.col("n_unlabelled") > 0.5 * F.col("n_docs")),
        (2, "CRITICAL", "Minority class below 20% of labelled rows", "MEDIUM - metrics need class weighting",
         F.col("minority_share") < 0.2),
        (3, "MAJOR", "Duplicate texts present", "LOW - inflated counts and leakage across splits",
         F.col("n_docs") > F.col("n_texts")),
        (4, "MAJOR", "Very short texts present", "LOW - near-empty training rows", F.col("n_short") > 0),
    ]
    return B.issue_report(facts, rules)
