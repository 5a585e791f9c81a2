"""Probe, curriculum and evaluation-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import curriculum as C
from corpusflow.operators import metrics as M
from corpusflow.operators import probe as P
from corpusflow.plans.registry import query
from corpusflow.sources.tables import Tables

SEED = 42

PROBE_SQL = """
c AS (SELECT label, pos, AVG(x) AS v FROM (
        SELECT label, CAST(UNNEST(embedding) AS DOUBLE) AS x, UNNEST(range(len(embedding))) AS pos FROM embeddings)
      GROUP BY label, pos),
cm AS (SELECT label AS k, list(v ORDER BY pos) AS cv FROM c GROUP BY label),
cls AS (SELECT list(k ORDER BY k) AS classes FROM cm),
lg AS (SELECT e.vec_id, e.label, list(list_dot_product(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), cm.cv) ORDER BY cm.k) AS logits
       FROM embeddings e CROSS JOIN cm GROUP BY e.vec_id, e.label),
pr AS (SELECT lg.*, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred,
              list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM lg),
pb AS (SELECT pr.*, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM pr),
en AS (SELECT pb.*, -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) AS h FROM pb)"""


def probe(spark, d):
    """(vec_id, label, logits, classes, pred, probs, entropy) from the centroid probe."""
    e = Tables(spark, d).embeddings
    lg = C.probe_logits(e, "label", "embedding")
    p = C.softmax(F.col("logits"))
    return (lg.withColumn("pred", C.argmax(F.col("logits")))
              .withColumn("probs", p).withColumn("entropy", C.entropy(F.col("probs"))))


def _pred_label(df):
    # prediction index -> class label (classes are the sorted labels)
    return df.withColumn("pred", F.element_at("classes", F.col("pred") + 1))


@query("centroid_probe", f"""WITH {PROBE_SQL}
SELECT vec_id, label, cls.classes[pred + 1] AS pred, ROUND(list_max(logits), 6) AS logit_max FROM pr, cls""")
def centroid_probe(spark, d):
    p = _pred_label(probe(spark, d))
    return p.select("vec_id", "label", "pred", F.round(F.array_max("logits"), 6).alias("logit_max"))


PROBE_STEPS, PROBE_RATE, PROBE_L2 = 6, 0.5, 0.01

# the same steps as a recursion over the weight matrix: one aggregate over all rows a step
TRAIN_SQL = f"""
WITH RECURSIVE cl AS (SELECT list(k ORDER BY k) AS ks FROM (SELECT DISTINCT label AS k FROM embeddings)),
x AS (SELECT vec_id, label, list_position(ks, label) AS y,
             list_concat(list_transform(embedding, lambda v: v::DOUBLE), [1.0::DOUBLE]) AS x FROM embeddings, cl),
sz AS (SELECT COUNT(*)::DOUBLE AS n_all, MAX(len(x)) AS dim, (SELECT len(ks) FROM cl) AS n_cls FROM x),
w AS (SELECT 0 AS step, list_transform(range(n_cls), lambda a: list_transform(range(dim), lambda b: 0.0::DOUBLE)) AS w FROM sz
      UNION ALL
      SELECT step + 1, list(wk ORDER BY k) FROM (
        SELECT step, k, list(v ORDER BY j) AS wk FROM (
          SELECT step, k, j, any_value(w[k][j]) * (1 - {PROBE_RATE} * {PROBE_L2})
                 - {PROBE_RATE} * SUM((p[k] - CASE WHEN y = k THEN 1 ELSE 0 END) * x[j]) / any_value(n_all) AS v
          FROM (SELECT step, w, y, x, list_transform(e, lambda v: v / list_sum(e)) AS p FROM (
                  SELECT step, w, y, x, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM (
                    SELECT step, w, y, x, list_transform(w, lambda r: list_dot_product(r, x)) AS l
                    FROM w, x WHERE step < {PROBE_STEPS}))) q, sz, range(1, sz.n_cls + 1) t(k), range(1, sz.dim + 1) u(j)
          GROUP BY step, k, j) GROUP BY step, k) GROUP BY step),
sc AS (SELECT step, vec_id, label, y, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM (
         SELECT step, vec_id, label, y, list_transform(w, lambda r: list_dot_product(r, x)) AS l FROM w, x)),
pr AS (SELECT step, vec_id, label, y, list_transform(e, lambda v: v / list_sum(e)) AS p FROM sc)"""


def _trained(spark, d):
    e = Tables(spark, d).embeddings
    return e, P.train_probe(e, "label", "embedding", steps=PROBE_STEPS, rate=PROBE_RATE, l2=PROBE_L2)


@query("trained_probe", TRAIN_SQL + f"""
SELECT vec_id, label, ks[list_position(p, list_max(p))] AS pred, ROUND(list_max(p), 6) AS p_max FROM pr, cl WHERE step = {PROBE_STEPS}""")
def trained_probe(spark, d):
    """Predictions of a linear probe after a fixed number of full-batch steps on the frozen features (C1, trained)."""
    e, history = _trained(spark, d)
    p = P.apply_probe(e, "embedding", history, PROBE_STEPS)
    return p.select("vec_id", "label", F.element_at("classes", C.argmax(F.col("probs")) + 1).alias("pred"),
                    F.round(F.array_max("probs"), 6).alias("p_max"))


@query("probe_training", TRAIN_SQL + f""",
sq AS (SELECT step, list_sum(list_transform(w, lambda r: list_dot_product(r, r))) AS w2 FROM w)
SELECT step, COUNT(*) AS n_rows, ROUND(AVG(-ln(p[y])) + any_value(w2) * {PROBE_L2 / 2}, 6) AS loss,
       ROUND(AVG(CASE WHEN list_position(p, list_max(p)) = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pr JOIN sq USING (step) GROUP BY step""")
def probe_training(spark, d):
    """Loss and accuracy at every step of the training, the accuracy from scoring all rows with that step's weights."""
    e, history = _trained(spark, d)
    every = history.select("step", "classes", "W")  # a row a step
    x = F.concat(C.as_double_array(F.col("embedding")), F.array(F.lit(1.0)))
    s = e.crossJoin(F.broadcast(every)).select("step", (F.element_at("classes", C.argmax(F.transform("W", lambda w: C.dot(x, w))) + 1) == F.col("label")).alias("hit"))
    acc = s.groupBy("step").agg(F.avg(F.col("hit").cast("double")).alias("accuracy"))
    return history.join(acc, "step").select("step", "n_rows", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query("probe_entropy", f"WITH {PROBE_SQL} SELECT vec_id, ROUND(h, 6) AS entropy FROM en")
def probe_entropy(spark, d):
    return probe(spark, d).select("vec_id", F.round("entropy", 6).alias("entropy"))


TERTILE_SQL = f"""WITH {PROBE_SQL},
tt AS (SELECT vec_id, CAST(NTILE(3) OVER (ORDER BY ROUND(h, 9), vec_id) AS INTEGER) AS tertile FROM en)"""


@query("curriculum_tertiles", TERTILE_SQL + """
SELECT vec_id, tertile, CASE tertile WHEN 1 THEN 'easy' WHEN 2 THEN 'medium' ELSE 'hard' END AS bin FROM tt""")
def curriculum_tertiles(spark, d):
    b = C.tertiles(probe(spark, d), F.col("entropy"), "vec_id")
    return b.select("vec_id", "tertile", "bin")


@query("curriculum_schedule", TERTILE_SQL + """,
ph AS (SELECT * FROM (VALUES (1, 1, 0.0, 0.2), (2, 2, 0.2, 0.6), (3, 3, 0.6, 1.0)) AS t(phase, max_bin, s_from, s_to)),
st AS (SELECT CEIL(COUNT(*) / 8) * 3 AS steps FROM tt)
SELECT ph.phase, ph.max_bin, CAST(COUNT(tt.vec_id) AS BIGINT) AS n_rows,
       CAST(FLOOR(ph.s_from * st.steps) AS BIGINT) AS from_step, CAST(FLOOR(ph.s_to * st.steps) AS BIGINT) AS to_step,
       CAST(CASE WHEN ph.phase IN (2, 3) THEN COUNT(tt.vec_id) ELSE 0 END AS BIGINT) AS n_augmented
FROM ph CROSS JOIN st LEFT JOIN tt ON tt.tertile <= ph.max_bin GROUP BY ph.phase, ph.max_bin, ph.s_from, ph.s_to, st.steps""")
def curriculum_schedule(spark, d):
    b = C.tertiles(probe(spark, d), F.col("entropy"), "vec_id")
    return C.schedule(b, 8, 3).select("phase", "max_bin", "n_rows", "from_step", "to_step", "n_augmented")


@query("mixup_pairs", f"""
WITH r AS (SELECT vec_id, label, embedding, ROW_NUMBER() OVER (ORDER BY md5('{SEED}|' || CAST(vec_id AS VARCHAR)), vec_id) AS rn,
                  COUNT(*) OVER () AS n FROM embeddings),
j AS (SELECT a.vec_id, b.vec_id AS partner, a.label, b.label AS partner_label,
             list_transform(list_zip(a.embedding, b.embedding), lambda z: 0.7 * CAST(z[1] AS DOUBLE) + 0.3 * CAST(z[2] AS DOUBLE)) AS mixed
      FROM r a JOIN r b ON b.rn = CASE WHEN a.rn = a.n THEN 1 ELSE a.rn + 1 END)
SELECT vec_id, partner, CAST(0.7 AS DOUBLE) AS lam, ROUND(sqrt(list_sum(list_transform(mixed, lambda x: x * x))), 6) AS mix_norm,
       ROUND(CAST(0.7 + CASE WHEN label = partner_label THEN 0.3 ELSE 0.0 END AS DOUBLE), 6) AS own_label_weight FROM j""")
def mixup_pairs(spark, d):
    e = Tables(spark, d).embeddings
    m = C.mixup_pairs(e, "vec_id", "embedding", "label", SEED, lam=0.7)
    return m.select("vec_id", "partner", "lam", F.round(F.sqrt(C.dot(F.col("mixed"), F.col("mixed"))), 6).alias("mix_norm"),
                    F.round("own_label_weight", 6).alias("own_label_weight"))


@query("label_smoothing", """
SELECT vec_id, CAST(k AS INTEGER) AS k, ROUND(CASE WHEN k = label THEN 0.9 ELSE 0.0 END + 0.1 / 10, 6) AS p
FROM embeddings, range(0, 10) t(k)""")
def label_smoothing(spark, d):
    e = Tables(spark, d).embeddings
    s = e.select("vec_id", F.posexplode(C.label_smoothing(F.col("label"), 10, 0.1)).alias("k", "p"))
    return s.select("vec_id", "k", F.round("p", 6).alias("p"))


@query("noise_aware_loss", f"""WITH {PROBE_SQL}
SELECT vec_id, ROUND(-ln(p[list_position(cls.classes, label)]), 6) AS ce,
       ROUND((1 - pow(p[list_position(cls.classes, label)], 0.7)) / 0.7, 6) AS gce FROM en, cls""")
def noise_aware_loss(spark, d):
    p = probe(spark, d)
    py = F.element_at("probs", F.array_position("classes", F.col("label")).cast("int"))
    return p.select("vec_id", F.round(C.cross_entropy(py), 6).alias("ce"), F.round(C.generalized_ce(py, 0.7), 6).alias("gce"))


@query("centroid_cosine", """
WITH c AS (SELECT label, pos, AVG(x) AS v FROM (
        SELECT label, CAST(UNNEST(embedding) AS DOUBLE) AS x, UNNEST(range(len(embedding))) AS pos FROM embeddings)
      GROUP BY label, pos),
cm AS (SELECT label AS k, list(v ORDER BY pos) AS cv FROM c GROUP BY label)
SELECT a.k AS g1, b.k AS g2, ROUND(list_cosine_similarity(a.cv, b.cv), 6) AS cosine FROM cm a JOIN cm b ON a.k < b.k""")
def centroid_cosine(spark, d):
    c = C.centroid_cosine(Tables(spark, d).embeddings, "label", "embedding")
    return c.select("g1", "g2", F.round("cosine", 6).alias("cosine"))


@query("argmax_prediction", f"WITH {PROBE_SQL} SELECT vec_id, pred AS pred_index FROM pr")
def argmax_prediction(spark, d):
    return probe(spark, d).select("vec_id", F.col("pred").alias("pred_index"))


PRED_SQL = f"""WITH {PROBE_SQL}, pl AS (SELECT vec_id, label, cls.classes[pred + 1] AS pred FROM pr, cls)"""


def predictions(spark, d):
    return _pred_label(probe(spark, d)).select("vec_id", "label", "pred")


@query("accuracy", PRED_SQL + " SELECT ROUND(AVG(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM pl")
def accuracy(spark, d):
    return M.accuracy(predictions(spark, d)).select(F.round("accuracy", 4).alias("accuracy"))


@query("confusion_matrix", PRED_SQL + " SELECT label, pred, COUNT(*) AS n FROM pl GROUP BY label, pred")
def confusion_matrix(spark, d):
    return M.confusion(predictions(spark, d))


PER_CLASS_SQL = """,
ks AS (SELECT label AS k FROM pl UNION SELECT pred FROM pl),
pc AS (SELECT ks.k, COUNT(*) FILTER (WHERE pl.label = ks.k AND pl.pred = ks.k) AS tp,
              COUNT(*) FILTER (WHERE pl.pred = ks.k) AS predicted, COUNT(*) FILTER (WHERE pl.label = ks.k) AS support
       FROM ks CROSS JOIN pl GROUP BY ks.k),
pm AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS prec,
              CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec FROM pc),
pf AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM pm)"""


@query("weighted_prf", PRED_SQL + PER_CLASS_SQL + """
SELECT ROUND(SUM(prec * support) / SUM(support), 4) AS precision, ROUND(SUM(rec * support) / SUM(support), 4) AS recall,
       ROUND(SUM(f1 * support) / SUM(support), 4) AS f1 FROM pf""")
def weighted_prf(spark, d):
    w = M.weighted_prf(predictions(spark, d))
    return w.select(*[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


@query("macro_f1", PRED_SQL + PER_CLASS_SQL + """
SELECT ROUND(AVG(prec), 4) AS precision, ROUND(AVG(rec), 4) AS recall, ROUND(AVG(f1), 4) AS f1 FROM pf""")
def macro_f1(spark, d):
    w = M.macro_prf(predictions(spark, d))
    return w.select(*[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


@query("eval_metrics", PRED_SQL + PER_CLASS_SQL + """
SELECT 'weighted' AS average, ROUND((SELECT AVG(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) FROM pl), 4) AS accuracy,
       ROUND(SUM(f1 * support) / SUM(support), 4) AS f1, ROUND(SUM(prec * support) / SUM(support), 4) AS precision,
       ROUND(SUM(rec * support) / SUM(support), 4) AS recall FROM pf""")
def eval_metrics(spark, d):
    return M.metrics(predictions(spark, d), 10)


BIN_PRED_SQL = """
WITH b AS (SELECT l.quality AS label, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS pred
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT COUNT(*) FILTER (WHERE pred = 1 AND label = 1) AS tp, COUNT(*) FILTER (WHERE pred = 1) AS pp,
             COUNT(*) FILTER (WHERE label = 1) AS ap FROM b),
m AS (SELECT CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS p, CASE WHEN ap > 0 THEN tp / ap ELSE 0 END AS r FROM s)"""


@query("binary_prf", BIN_PRED_SQL + """
SELECT ROUND(p, 4) AS precision, ROUND(r, 4) AS recall, ROUND(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM m""")
def binary_prf(spark, d):
    t = Tables(spark, d)
    b = t.documents.join(t.labels, "doc_id").select(F.col("quality").alias("label"),
                                                   F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("pred"))
    return M.binary_prf(b).select(*[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


@query("throughput", """
SELECT user_id, COUNT(*) AS n_events, ROUND(date_diff('microsecond', MIN(ts), MAX(ts)) / 1e6, 6) AS span_s,
       ROUND(CASE WHEN MAX(ts) > MIN(ts) THEN COUNT(*) / (date_diff('microsecond', MIN(ts), MAX(ts)) / 1e6) END, 6) AS rows_per_s,
       ROUND(CASE WHEN MAX(ts) > MIN(ts) THEN CEIL(COUNT(*) / 8) / (date_diff('microsecond', MIN(ts), MAX(ts)) / 1e6) END, 6) AS steps_per_s
FROM events GROUP BY user_id""")
def throughput(spark, d):
    from corpusflow.operators.schema import seconds_between
    e = Tables(spark, d).events
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), seconds_between(F.min("ts"), F.max("ts")).alias("span"))
    tp = M.throughput(F.col("n_events"), F.when(F.col("span") > 0, F.col("span")), 8)
    return g.select("user_id", "n_events", F.round("span", 6).alias("span_s"),
                    F.round(tp["rows_per_s"], 6).alias("rows_per_s"), F.round(tp["steps_per_s"], 6).alias("steps_per_s"))
