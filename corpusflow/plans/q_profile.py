"""Group statistics, profiles and ordered reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import profile as G
from corpusflow.operators.ranks import segmented_scan
from corpusflow.operators.schema import json_field
from corpusflow.plans.registry import query
from corpusflow.sources.tables import Tables


def _events_k(t: Tables):
    return t.events.withColumn("k", json_field(F.col("props"), "$.k", "double"))


@query("group_mean", """
SELECT event_type, ROUND(AVG(value), 6) AS mean_value FROM events GROUP BY event_type""")
def group_mean(spark, d):
    g = G.group_mean(Tables(spark, d).events, "event_type", ["value"])
    return g.select("event_type", F.round("mean_value", 6).alias("mean_value"))


@query("group_mean_std", """
SELECT user_id, event_type, COUNT(*) AS n,
       ROUND(AVG(value), 6) AS mean_value, ROUND(STDDEV_SAMP(value), 6) AS std_value,
       ROUND(AVG(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k,
       ROUND(STDDEV_SAMP(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS std_k
FROM events GROUP BY user_id, event_type""")
def group_mean_std(spark, d):
    e = _events_k(Tables(spark, d))
    g = G.group_mean_std(e, ["user_id", "event_type"], ["value", "k"])
    return g.select("user_id", "event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean_value", "std_value", "mean_k", "std_k")])


@query("summary_stats_pop", """
SELECT COUNT(n) AS n, MIN(n) AS min_v, MAX(n) AS max_v, ROUND(AVG(n), 6) AS mean_v, ROUND(STDDEV_POP(n), 6) AS std_v
FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id)""")
def summary_stats_pop(spark, d):
    per = Tables(spark, d).events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    s = G.summary_stats_pop(per, "n")
    return s.select("n", "min_v", "max_v", F.round("mean_v", 6).alias("mean_v"), F.round("std_v", 6).alias("std_v"))


@query("vector_stats", """
SELECT vec_id, ROUND(AVG(x), 6) AS mean, ROUND(AVG(ABS(x)), 6) AS abs_mean, ROUND(STDDEV_SAMP(x), 6) AS std
FROM (SELECT vec_id, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id""")
def vector_stats(spark, d):
    e = Tables(spark, d).embeddings
    st = G.array_stats(F.col("embedding"))
    return e.select("vec_id", *[F.round(v, 6).alias(k) for k, v in st.items()])


@query("inventory_accounting", """
SELECT CAST(SUM(d.n_chars) AS BIGINT) AS total_chars,
       CAST(SUM(CASE WHEN l.doc_id IS NOT NULL THEN d.n_chars ELSE 0 END) AS BIGINT) AS labelled_chars,
       CAST(SUM(CASE WHEN l.quality = 1 THEN d.n_chars ELSE 0 END) AS BIGINT) AS quality_chars,
       ROUND(100.0 * SUM(CASE WHEN l.doc_id IS NOT NULL THEN d.n_chars ELSE 0 END) / SUM(d.n_chars), 6) AS labelled_pct,
       ROUND(100.0 * SUM(CASE WHEN l.quality = 1 THEN d.n_chars ELSE 0 END) / SUM(d.n_chars), 6) AS quality_pct,
       ROUND(SUM(CASE WHEN l.quality = 1 THEN d.n_chars ELSE 0 END) / SUM(CASE WHEN l.doc_id IS NOT NULL THEN d.n_chars ELSE 0 END), 6) AS efficiency
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def inventory_accounting(spark, d):
    t = Tables(spark, d)
    j = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", F.lit(True).alias("_l"), "quality"), "doc_id", "left")
    s = j.agg(F.sum("n_chars").alias("total_chars"),
              F.sum(F.when(F.col("_l"), F.col("n_chars")).otherwise(0)).alias("labelled_chars"),
              F.sum(F.when(F.col("quality") == 1, F.col("n_chars")).otherwise(0)).alias("quality_chars"))
    return s.select("total_chars", "labelled_chars", "quality_chars",
                    F.round(100.0 * F.col("labelled_chars") / F.col("total_chars"), 6).alias("labelled_pct"),
                    F.round(100.0 * F.col("quality_chars") / F.col("total_chars"), 6).alias("quality_pct"),
                    F.round(F.try_divide(F.col("quality_chars"), F.col("labelled_chars")), 6).alias("efficiency"))


@query("path_group_mean", r"""
WITH p AS (SELECT length(html) AS score, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS parts FROM pages),
q AS (SELECT score, parts, COALESCE(list_position(list_transform(parts, lambda x: regexp_full_match(x, '[0-9]+')), true), 0) AS idx FROM p)
SELECT 'layer_' || parts[idx] || CASE WHEN idx < len(parts) THEN '_' || parts[idx + 1] ELSE '' END AS group_key,
       ROUND(AVG(score), 6) AS mean_score, COUNT(*) AS n_items
FROM q WHERE idx > 0 GROUP BY 1""")
def path_group_mean(spark, d):
    p = Tables(spark, d).pages
    x = p.select(F.length("html").alias("score"), F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    g = G.path_group_mean(x, "path", "score", sep="/")
    return g.select("group_key", F.round("mean_score", 6).alias("mean_score"), "n_items")


@query("group_by_value", """
SELECT n_regionkey, COUNT(*) AS n_names, array_to_string(list_sort(list(n_name)), ',') AS names
FROM nation GROUP BY n_regionkey""")
def group_by_value(spark, d):
    g = G.group_by_value(Tables(spark, d).nation, "n_regionkey", "n_name")
    return g.select("n_regionkey", "n_names", F.array_join("names", ",").alias("names"))


@query("median_int", r"""
SELECT lang, CAST(TRUNC(QUANTILE_CONT(len(string_split_regex(trim(text), '[ \t\n\r]+')), 0.5)) AS INTEGER) AS median_int
FROM documents GROUP BY lang""")
def median_int(spark, d):
    docs = Tables(spark, d).documents
    w = docs.select("lang", F.size(F.split(F.trim("text"), r"[ \t\n\r]+")).alias("words"))
    return G.median_int(w, "lang", "words")


@query("distinct_values", """
SELECT source, COUNT(DISTINCT lang) AS n_langs, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs
FROM documents GROUP BY source""")
def distinct_values(spark, d):
    docs = Tables(spark, d).documents
    return docs.groupBy("source").agg(F.count_distinct("lang").alias("n_langs"),
                                      F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"))


@query("run_status_summary", """
SELECT o_orderpriority AS run_set, COUNT(*) AS n_runs, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_success,
       COUNT(*) FILTER (WHERE o_orderstatus <> 'F') AS n_failed,
       ROUND(COUNT(*) FILTER (WHERE o_orderstatus = 'F') / COUNT(*), 6) AS success_rate
FROM orders GROUP BY o_orderpriority""")
def run_status_summary(spark, d):
    o = Tables(spark, d).orders
    g = o.groupBy(F.col("o_orderpriority").alias("run_set")).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("o_orderstatus") == "F").alias("n_success"),
        F.count_if(F.col("o_orderstatus") != "F").alias("n_failed"))
    return g.withColumn("success_rate", F.round(F.col("n_success") / F.col("n_runs"), 6))


@query("sets_overview", """
SELECT o_orderstatus AS run_set, COUNT(*) AS n_entries,
       CASE o_orderstatus WHEN 'F' THEN 'finished runs' WHEN 'O' THEN 'open runs' ELSE 'No description' END AS description
FROM orders GROUP BY o_orderstatus""")
def sets_overview(spark, d):
    o = Tables(spark, d).orders
    desc = {"F": "finished runs", "O": "open runs"}
    m = F.create_map(*[x for k, v in desc.items() for x in (F.lit(k), F.lit(v))])
    g = o.groupBy(F.col("o_orderstatus").alias("run_set")).agg(F.count(F.lit(1)).alias("n_entries"))
    return g.withColumn("description", F.coalesce(F.try_element_at(m, F.col("run_set")), F.lit("No description")))


DAYS = list(range(7))


@query("heatmap_pivot", "SELECT event_type, " + ", ".join(
    f"COUNT(*) FILTER (WHERE isodow(ts) - 1 = {i}) AS d{i}" for i in DAYS) + " FROM events GROUP BY event_type")
def heatmap_pivot(spark, d):
    e = Tables(spark, d).events.select("event_type", F.weekday("ts").alias("wd"))
    p = e.groupBy("event_type").pivot("wd", DAYS).agg(F.count(F.lit(1)))
    return p.select("event_type", *[F.coalesce(F.col(str(i)), F.lit(0)).cast("bigint").alias(f"d{i}") for i in DAYS])


@query("top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def top_k(spark, d):
    return G.top_k(Tables(spark, d).documents.select("doc_id", "n_chars"), "n_chars", "doc_id", 5)


@query("best_per_group", """
SELECT user_id, event_id, event_type, value FROM (
  SELECT user_id, event_id, event_type, value,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def best_per_group(spark, d):
    e = Tables(spark, d).events.select("user_id", "event_id", "event_type", "value")
    return G.best_per_group(e, "user_id", "value", "event_id")


@query("steps_to_target", """
SELECT u.user_id, s.step FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (
  SELECT user_id, MIN(step) AS step FROM (
    SELECT user_id, ROW_NUMBER() OVER w AS step, SUM(value) OVER w AS running FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WHERE running >= 500 GROUP BY user_id) s ON u.user_id = s.user_id""")
def steps_to_target(spark, d):
    e = Tables(spark, d).events.select("user_id", "event_id", "ts", "value")
    r = segmented_scan(e, ["user_id"], ["ts", "event_id"], value="value")
    hit = r.where(F.col("running") >= 500).groupBy("user_id").agg(F.min("step").alias("step"))
    return e.select("user_id").distinct().join(hit, "user_id", "left")


@query("fractional_epoch", """
SELECT user_id, event_id, step, ROUND(step / CEIL(n / 8.0), 6) AS epoch FROM (
  SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
         COUNT(*) OVER (PARTITION BY user_id) AS n FROM events)""")
def fractional_epoch(spark, d):
    e = Tables(spark, d).events.select("user_id", "event_id", "ts")
    r = segmented_scan(e, ["user_id"], ["ts", "event_id"], total_out="n")
    return r.select("user_id", "event_id", "step", F.round(F.col("step") / F.ceil(F.col("n") / 8.0), 6).alias("epoch"))
