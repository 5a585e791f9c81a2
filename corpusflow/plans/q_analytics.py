"""Experiment results and analytics queries.

Runs are derived from ``events``: a run scores the rule ``value > 5`` against
the truth ``props.k > 50``.  Single-task runs are one per (event type, user);
few-shot runs take ``n`` events per (event type, truth class) with the seeded
per-class rank.  Event types stand for methods.  The runs are compiled into
result documents, written as JSON (plus one corrupt file), scanned back and
summarised.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.hashing import hash_order
from corpusflow.operators import analytics as A
from corpusflow.operators import metrics as M
from corpusflow.operators import noise as NZ
from corpusflow.operators.ranks import class_rank
from corpusflow.operators.schema import iso_string, json_field, seconds_between
from corpusflow.plans.registry import query
from corpusflow.session import checkpoint_dir, scratch_dir
from corpusflow.sources import results as R
from corpusflow.sources.tables import Tables

SEED = 42
SHOTS = [8, 16, 32, 64, 128]
# Event type -> method name of the run
METHODS = [("view", "lora"), ("click", "ba_lora"), ("purchase", "adapter"), ("signup", "hybrid"), ("error", "full")]
METRICS = ["accuracy", "f1", "precision", "recall"]


def _events(t: Tables):
    e = t.events
    return e.select("event_id", "event_type", "user_id", "ts", "value",
                    (json_field(F.col("props"), "$.k", "int") > 50).cast("int").alias("truth"),
                    (F.col("value") > 5).cast("int").alias("pred"))


def _run_aggs():
    return [F.count(F.lit(1)).alias("n"),
            F.count_if((F.col("pred") == 1) & (F.col("truth") == 1)).alias("tp"),
            F.count_if(F.col("pred") == 1).alias("pp"), F.count_if(F.col("truth") == 1).alias("ap"),
            F.count_if(F.col("pred") == F.col("truth")).alias("correct"),
            F.min("ts").alias("t0"), F.max("ts").alias("t1")]


def runs(spark, d):
    """One row per run with its metrics and configuration columns."""
    e = _events(Tables(spark, d))
    a = (e.groupBy("event_type", "user_id").agg(*_run_aggs())
          .withColumn("experiment_name", F.concat("event_type", F.lit("_u"), F.col("user_id").cast("string")))
          .withColumn("n_shots", F.lit(None).cast("int")))
    r = class_rank(e, ["event_type", "truth"], hash_order(SEED, "event_id"), "event_id", max_rank=max(SHOTS))
    s = spark.createDataFrame([(n,) for n in SHOTS], "n_shots int")
    b = (r.join(F.broadcast(s), F.col("rank") <= F.col("n_shots")).groupBy("event_type", "n_shots").agg(*_run_aggs())
          .withColumn("experiment_name", F.concat("event_type", F.lit("_"), F.col("n_shots").cast("string"), F.lit("shot"))))
    cols = ["event_type", "experiment_name", "n_shots", "n", "tp", "pp", "ap", "correct", "t0", "t1"]
    u = a.select(*cols).unionByName(b.select(*cols))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("pp")), F.lit(0.0))
    rc = F.coalesce(F.try_divide(F.col("tp"), F.col("ap")), F.lit(0.0))
    mth = F.create_map(*[x for k, v in METHODS for x in (F.lit(k), F.lit(v))])
    dur = seconds_between(F.col("t0"), F.col("t1"))
    out = u.select(
        "experiment_name", "n_shots", "n", F.element_at(mth, F.col("event_type")).alias("peft_method"),
        (F.col("correct") / F.col("n")).alias("eval_accuracy"), p.alias("eval_precision"), rc.alias("eval_recall"),
        F.coalesce(F.try_divide(2 * p * rc, p + rc), F.lit(0.0)).alias("eval_f1"),
        iso_string(F.col("t0")).alias("timestamp"), dur.alias("duration_seconds"))
    # one row per run: a run-level table read by several branches of each
    # analytics query, so it is materialised once (reliable checkpoint)
    checkpoint_dir(spark)
    return out.checkpoint(eager=True)


def results(spark, d):
    """Compiled result documents (E2), one struct per run."""
    r = runs(spark, d)
    c = {k: F.col(k) for k in ("experiment_name", "timestamp", "duration_seconds", "peft_method", "eval_accuracy",
                               "eval_f1", "eval_precision", "eval_recall")}
    c.update({
        "model": F.lit("centroid-probe"), "dataset": F.lit("events"), "epochs": F.lit(3), "batch_size": F.lit(8),
        "learning_rate": F.lit(5e-4), "seed": F.lit(SEED), "max_length": F.lit(128), "lora_r": F.lit(8),
        "base_rank": F.lit(4), "gradient_samples": F.lit(1000),
        "eval_loss": 1 - F.col("eval_accuracy"), "eval_runtime": F.col("duration_seconds"),
        "eval_samples_per_second": F.try_divide(F.col("n"), F.col("duration_seconds")),
        "eval_steps_per_second": F.try_divide(F.ceil(F.col("n") / 8), F.col("duration_seconds")),
        "epoch": F.lit(3.0), "trainable_parameters": (F.col("n") * 100).cast("bigint"),
        "target": F.when(F.col("peft_method") == "ba_lora", F.lit(37500).cast("bigint")),
        "used": (F.col("n") * 100).cast("bigint"),
    })
    return r.select(R.compile_result(c).alias("result"))


def scanned(spark, d):
    """Write the results as JSON plus a broken document for every event type, then scan them back."""
    path = scratch_dir(spark, "results")
    R.write_results(results(spark, d), path)
    broken = Tables(spark, d).events.select(F.concat(F.lit(BROKEN), "event_type").alias("value")).distinct()
    broken.write.mode("append").text(path)
    return R.read_results(spark, path, lines=True)


RUNS_SQL = f"""
ev AS (SELECT event_id, event_type, user_id, ts, value,
              CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 AS INTEGER) AS truth,
              CAST(value > 5 AS INTEGER) AS pred FROM events),
ra AS (SELECT event_type, event_type || '_u' || user_id AS experiment_name, CAST(NULL AS INTEGER) AS n_shots,
              COUNT(*) AS n, COUNT(*) FILTER (WHERE pred = 1 AND truth = 1) AS tp, COUNT(*) FILTER (WHERE pred = 1) AS pp,
              COUNT(*) FILTER (WHERE truth = 1) AS ap, COUNT(*) FILTER (WHERE pred = truth) AS correct, MIN(ts) AS t0, MAX(ts) AS t1
       FROM ev GROUP BY event_type, user_id),
rk AS (SELECT ev.*, ROW_NUMBER() OVER (PARTITION BY event_type, truth ORDER BY md5('{SEED}|' || CAST(event_id AS VARCHAR)), event_id) AS rn FROM ev),
rb AS (SELECT event_type, event_type || '_' || s.n_shots || 'shot' AS experiment_name, s.n_shots,
              COUNT(*) AS n, COUNT(*) FILTER (WHERE pred = 1 AND truth = 1) AS tp, COUNT(*) FILTER (WHERE pred = 1) AS pp,
              COUNT(*) FILTER (WHERE truth = 1) AS ap, COUNT(*) FILTER (WHERE pred = truth) AS correct, MIN(ts) AS t0, MAX(ts) AS t1
       FROM rk JOIN (SELECT CAST(UNNEST([{', '.join(map(str, SHOTS))}]) AS INTEGER) AS n_shots) s ON rk.rn <= s.n_shots
       GROUP BY event_type, s.n_shots),
ru AS (SELECT * FROM ra UNION ALL SELECT * FROM rb),
rm AS (SELECT *, correct / n AS acc, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS prec,
              CASE WHEN ap > 0 THEN tp / ap ELSE 0.0 END AS rec, date_diff('microsecond', t0, t1) / 1e6 AS dur,
              CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in METHODS)} END AS method FROM ru),
runs AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM rm)"""


@query("results_scan", f"""WITH {RUNS_SQL}
SELECT experiment_name, method, ROUND(acc, 6) AS accuracy, ROUND(dur, 6) AS duration_s, strftime(t0, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM runs""")
def results_scan(spark, d):
    good, _ = scanned(spark, d)
    return good.select("experiment_name", F.col("config.peft_method").alias("method"),
                       F.round("eval_results.eval_accuracy", 6).alias("accuracy"),
                       F.round("duration_seconds", 6).alias("duration_s"), "timestamp")


BROKEN = '{"experiment_name": broken '


@query("results_corrupt", f"""
SELECT DISTINCT '{BROKEN}' || event_type AS _corrupt, CAST(NULL AS VARCHAR) AS experiment_name FROM events""")
def results_corrupt(spark, d):
    """Broken result documents are reported, each by itself, and not fatal to the good ones beside them."""
    _, bad = scanned(spark, d)
    # Spark refuses a raw-JSON query that reads only the corrupt-record column
    return bad.select("_corrupt", "experiment_name")


def summary(spark, d):
    good, _ = scanned(spark, d)
    return R.summary_table(good)


@query("summary_table", f"""WITH {RUNS_SQL}
SELECT experiment_name AS experiment, method, 'centroid-probe' AS model, 'events' AS dataset, 3 AS epochs,
       ROUND(acc * 100, 6) AS accuracy, ROUND(f1 * 100, 6) AS f1, ROUND(prec * 100, 6) AS precision,
       ROUND(rec * 100, 6) AS recall, ROUND(dur, 6) / 60 AS duration_min,
       CASE WHEN method = 'lora' THEN 8 END AS lora_r, CAST(NULL AS INTEGER) AS adapter_rf FROM runs""")
def summary_table(spark, d):
    s = summary(spark, d)
    # minutes = seconds / 60 ties at the 7th decimal for 1 in 60 runs; round the
    # seconds (microsecond precision, no ties) and divide, which is exact in IEEE
    return s.select("experiment", "method", "model", "dataset", "epochs", *[F.round(c, 6).alias(c) for c in METRICS],
                    (F.round(F.col("duration_min") * 60, 6) / 60).alias("duration_min"), "lora_r", "adapter_rf")


def _runs_pct(spark, d):
    """Flat runs (no JSON round trip) in percent, for the analytics below."""
    r = runs(spark, d)
    return r.select(F.col("experiment_name").alias("experiment"), F.col("peft_method").alias("method"), "n_shots",
                    (F.col("eval_accuracy") * 100).alias("accuracy"), (F.col("eval_f1") * 100).alias("f1"),
                    (F.col("eval_precision") * 100).alias("precision"), (F.col("eval_recall") * 100).alias("recall"))


PCT_SQL = RUNS_SQL + """,
pct AS (SELECT experiment_name AS experiment, method, n_shots, acc * 100 AS accuracy, f1 * 100 AS f1, prec * 100 AS precision,
               rec * 100 AS recall FROM runs)"""


@query("method_comparison", f"""WITH {PCT_SQL}
SELECT method, ROUND(AVG(accuracy), 6) AS accuracy, ROUND(AVG(f1), 6) AS f1, ROUND(AVG(precision), 6) AS precision,
       ROUND(AVG(recall), 6) AS recall FROM pct WHERE NOT contains(experiment, 'shot') GROUP BY method""")
def method_comparison(spark, d):
    m = A.method_comparison(_runs_pct(spark, d), METRICS)
    return m.select("method", *[F.round(c, 6).alias(c) for c in METRICS])


@query("learning_curve", f"""WITH {PCT_SQL}
SELECT method, CAST(regexp_extract(experiment, '(\\d+)shot', 1) AS INTEGER) AS n_shots,
       ROUND(AVG(accuracy), 6) AS accuracy, ROUND(AVG(f1), 6) AS f1
FROM pct WHERE contains(experiment, 'shot') GROUP BY 1, 2""")
def learning_curve(spark, d):
    c = A.learning_curve(_runs_pct(spark, d), ["accuracy", "f1"])
    return c.select("method", "n_shots", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


def _ms_sql(m: str) -> str:
    mean = f"printf('%.1f', ROUND(AVG({m}), 1))"
    std = f"printf('%.1f', ROUND(STDDEV_SAMP({m}), 1))"
    return (f"CASE WHEN STDDEV_SAMP({m}) IS NOT NULL AND STDDEV_SAMP({m}) > 0 THEN '$' || {mean} || ' \\pm ' || {std} || '$' "
            f"ELSE '$' || {mean} || '$' END")


@query("mean_std_strings", f"""WITH {PCT_SQL}
SELECT method, {_ms_sql('accuracy')} AS accuracy, {_ms_sql('f1')} AS f1, {_ms_sql('precision')} AS precision,
       {_ms_sql('recall')} AS recall,
       upper(substr(method, 1, 1)) || lower(substr(method, 2)) || ' & ' || {_ms_sql('accuracy')} || ' & ' || {_ms_sql('f1')}
       || ' & ' || {_ms_sql('precision')} || ' & ' || {_ms_sql('recall')} || ' \\\\' AS row
FROM pct GROUP BY method""")
def mean_std_strings(spark, d):
    return A.mean_std_rows(_runs_pct(spark, d), METRICS)


@query("seed_stats", f"""WITH {PCT_SQL}
SELECT method, COUNT(*) AS n_seeds, ROUND(AVG(accuracy), 6) AS mean_accuracy, ROUND(STDDEV_SAMP(accuracy), 6) AS std_accuracy
FROM pct WHERE NOT contains(experiment, 'shot') GROUP BY method""")
def seed_stats(spark, d):
    s = A.single_task(_runs_pct(spark, d))
    g = s.groupBy("method").agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("accuracy").alias("m"), F.stddev_samp("accuracy").alias("s"))
    return g.select("method", "n_seeds", F.round("m", 6).alias("mean_accuracy"), F.round("s", 6).alias("std_accuracy"))


# Student's t in SQL by Simpson's rule over its density: P(|T| <= x) for df degrees of freedom
def _t_inside_sql(x: str, df: str, steps: int = 2000) -> str:
    density = (f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) "
               f"* pow(1 + pow({x} * i / {steps}.0, 2) / {df}, -({df} + 1) / 2.0)")
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(2 * {x} / {steps}.0 / 3 * list_sum(list_transform(range(0, {steps} + 1), lambda i: {weight} * {density})))"


@query("paired_t", f"""WITH RECURSIVE {PCT_SQL},
a AS (SELECT regexp_extract(experiment, '_u(\\d+)$', 1) AS u, accuracy FROM pct WHERE method = 'ba_lora' AND NOT contains(experiment, 'shot')),
b AS (SELECT regexp_extract(experiment, '_u(\\d+)$', 1) AS u, accuracy FROM pct WHERE method = 'lora' AND NOT contains(experiment, 'shot')),
d AS (SELECT a.accuracy - b.accuracy AS d FROM a JOIN b ON a.u = b.u),
s AS (SELECT COUNT(*) AS n_pairs, AVG(d) AS mean_diff, STDDEV_SAMP(d) AS sd_diff FROM d),
t AS (SELECT *, CASE WHEN sd_diff > 0 THEN mean_diff / (sd_diff / sqrt(n_pairs)) END AS t_stat, CAST(n_pairs - 1 AS INTEGER) AS df FROM s),
-- the critical value by halving: where the two-sided tail is 5 %
crit(lo, hi, it) AS (SELECT 0.0::DOUBLE, 700.0::DOUBLE, 0 UNION ALL
  SELECT CASE WHEN inside < 0.95 THEN mid ELSE lo END, CASE WHEN inside < 0.95 THEN hi ELSE mid END, it + 1
  FROM (SELECT lo, hi, it, (lo + hi) / 2 AS mid, {_t_inside_sql('((lo + hi) / 2)', 't.df')} AS inside FROM crit, t) WHERE it < 40)
SELECT 'ba_lora' AS method_a, 'lora' AS method_b, n_pairs, ROUND(mean_diff, 6) AS mean_diff, ROUND(t_stat, 6) AS t_stat, df,
       ROUND(1 - {_t_inside_sql('abs(t_stat)', 'df')}, 6) AS p_value,
       ROUND(crit.lo, 3) AS t_crit, COALESCE(abs(t_stat) > ROUND(crit.lo, 3), false) AS significant
FROM t, (SELECT lo FROM crit WHERE it = 40) AS crit""")
def paired_t(spark, d):
    s = A.single_task(_runs_pct(spark, d)).withColumn("u", F.regexp_extract("experiment", r"_u(\d+)$", 1))
    t = A.paired_t(s, "u", "method", "accuracy", "ba_lora", "lora")
    return t.select("method_a", "method_b", "n_pairs", F.round("mean_diff", 6).alias("mean_diff"),
                    F.round("t_stat", 6).alias("t_stat"), "df", F.round("p_value", 6).alias("p_value"), "t_crit", "significant")


@query("cohens_d", f"""WITH {PCT_SQL},
g AS (SELECT method, COUNT(*) AS n, AVG(accuracy) AS m, VAR_SAMP(accuracy) AS v FROM pct WHERE NOT contains(experiment, 'shot') GROUP BY method),
b AS (SELECT n AS nb, m AS mb, v AS vb FROM g WHERE method = 'lora')
SELECT method, ROUND((m - mb) / sqrt(((n - 1) * v + (nb - 1) * vb) / (n + nb - 2)), 6) AS cohens_d FROM g, b WHERE method <> 'lora'""")
def cohens_d(spark, d):
    c = A.cohens_d(A.single_task(_runs_pct(spark, d)), "method", "accuracy", "lora")
    return c.select("method", F.round("cohens_d", 6).alias("cohens_d"))


@query("success_flags", f"""WITH {PCT_SQL},
g AS (SELECT a.n_shots, a.accuracy - b.accuracy AS gap FROM pct a JOIN pct b ON a.n_shots = b.n_shots
      WHERE a.method = 'ba_lora' AND b.method = 'lora'),
l AS (SELECT *, LEAD(gap) OVER (ORDER BY n_shots) AS nxt FROM g)
SELECT bool_and(gap >= 0.5) AS all_above, COALESCE(MAX(CASE WHEN n_shots = 16 THEN gap >= 2 END), false) AS focus_ok,
       bool_and(COALESCE(gap >= nxt, true)) AS widening FROM l""")
def success_flags(spark, d):
    f = A.few_shot_runs(_runs_pct(spark, d))
    a = f.where(F.col("method") == "ba_lora").select("n_shots", F.col("accuracy").alias("_a"))
    b = f.where(F.col("method") == "lora").select("n_shots", F.col("accuracy").alias("_b"))
    gaps = a.join(b, "n_shots").select("n_shots", (F.col("_a") - F.col("_b")).alias("gap"))
    return A.success_flags(gaps, "n_shots", "gap", 0.5, 16, 2.0)


@query("baseline_delta", """
WITH m AS (SELECT CAST(ts AS DATE) AS day, event_type, AVG(value) AS mean_value FROM events GROUP BY 1, 2),
b AS (SELECT day, mean_value AS baseline FROM m WHERE event_type = 'view')
SELECT strftime(m.day, '%Y-%m-%d') AS day, m.event_type, ROUND(m.mean_value, 6) AS mean_value, ROUND(b.baseline, 6) AS baseline,
       ROUND(m.mean_value - b.baseline, 6) AS delta FROM m LEFT JOIN b ON m.day = b.day""")
def baseline_delta(spark, d):
    e = Tables(spark, d).events
    m = e.groupBy(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day"), "event_type").agg(F.avg("value").alias("mean_value"))
    r = A.baseline_delta(m, ["day"], "event_type", "mean_value", "view")
    return r.select("day", "event_type", *[F.round(c, 6).alias(c) for c in ("mean_value", "baseline", "delta")])


@query("robustness_drop", f"""
WITH b AS (SELECT l.doc_id, l.quality AS label, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS pred,
                  CASE WHEN (('0x' || substr(md5('{SEED}|' || CAST(l.doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0) < 0.1
                       THEN (l.quality + 1) % 2 ELSE l.quality END AS noisy
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT ROUND(AVG(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS clean_accuracy,
       ROUND(AVG(CASE WHEN pred = noisy THEN 1.0 ELSE 0.0 END), 6) AS noisy_accuracy,
       ROUND(AVG(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) - AVG(CASE WHEN pred = noisy THEN 1.0 ELSE 0.0 END), 6) AS drop
FROM b""")
def robustness_drop(spark, d):
    t = Tables(spark, d)
    b = t.documents.join(t.labels, "doc_id").select("doc_id", F.col("quality").alias("label"),
                                                   F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("pred"))
    b = NZ.flip_labels(b, "label", "doc_id", 0.1, 2, SEED, out="noisy")
    hit = lambda truth: F.avg(F.when(F.col("pred") == F.col(truth), 1.0).otherwise(0.0))
    j = b.agg(hit("label").alias("c"), hit("noisy").alias("n"))
    return j.select(F.round("c", 6).alias("clean_accuracy"), F.round("n", 6).alias("noisy_accuracy"),
                    F.round(F.col("c") - F.col("n"), 6).alias("drop"))


@query("ablation_delta", """
WITH p AS (SELECT event_type, COUNT(*) FILTER (WHERE (value > 5) = (TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) > 50)) AS num,
                  COUNT(*) AS den FROM events GROUP BY event_type),
t AS (SELECT SUM(num) AS tn, SUM(den) AS td FROM p)
SELECT 'without_' || event_type AS variant, ROUND(tn / td, 6) AS full, ROUND((tn - num) / (td - den), 6) AS metric,
       ROUND((tn - num) / (td - den) - tn / td, 6) AS delta FROM p, t""")
def ablation_delta(spark, d):
    e = _events(Tables(spark, d))
    parts = e.groupBy("event_type").agg(F.count_if(F.col("pred") == F.col("truth")).alias("num"), F.count(F.lit(1)).alias("den"))
    a = A.ablation_delta(parts, "event_type", "num", "den")
    return a.select("variant", *[F.round(c, 6).alias(c) for c in ("full", "metric", "delta")])


# Sweep name templates and their placeholder
TEMPLATES = [("E2_sst2_fewshot_{n}shot_lora", "n"), ("E2_sst2_fewshot_{n}shot_adapter", "n"), ("E2_sst2_fewshot_{n}shot_hybrid", "n"),
             ("E4_budget_{budget}_lora", "budget"), ("E4_budget_{budget}_adapter", "budget"), ("E4_budget_{budget}_hybrid", "budget")]
SWEEP_VALUES = {"n": [8, 16, 32, 64, 128], "budget": [25000, 37500, 75000, 150000, 300000]}


@query("sweep_grid", """
WITH t AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{tm}', '{ph}', '{v}')" for tm, ph in TEMPLATES for v in SWEEP_VALUES[ph]) + """) AS g(template, placeholder, value)),
l AS (SELECT DISTINCT lang FROM documents)
SELECT l.lang, replace(t.template, '{' || t.placeholder || '}', t.value) || '_' || l.lang AS name FROM t, l""")
def sweep_grid(spark, d):
    from corpusflow.operators.joins import template_grid
    g = template_grid(spark, TEMPLATES, SWEEP_VALUES)
    langs = Tables(spark, d).documents.select("lang").distinct()
    # the grid is fixed-size (templates x values): broadcast it to every language
    return langs.crossJoin(F.broadcast(g)).select("lang", F.concat("name", F.lit("_"), F.col("lang")).alias("name"))

