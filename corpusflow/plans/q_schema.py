"""Scans, sinks, projections, lookups and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import joins as J
from corpusflow.operators import sampling as S
from corpusflow.operators import schema as P
from corpusflow.plans.q_sampling import SEED, SPLIT3_SQL, labelled_docs
from corpusflow.plans.registry import query
from corpusflow.session import scratch_dir
from corpusflow.sources import csv_splits as CSV
from corpusflow.sources import versions as V
from corpusflow.sources.tables import Tables, load_named


@query("csv_split_roundtrip", f"""
SELECT s.doc_id, d.text, s.label, s.split FROM ({SPLIT3_SQL}) s JOIN documents d ON s.doc_id = d.doc_id""")
def csv_split_roundtrip(spark, d):
    t = Tables(spark, d)
    docs = labelled_docs(t).select("doc_id", "label")
    sp = S.stratified_split3(docs, "label", 0.1, 0.1, SEED, "doc_id")
    full = sp.join(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", "text", "label", "split")
    out = scratch_dir(spark, "csv")
    CSV.write_split_csv(full, out, "labelled")
    return CSV.load_split_csv(spark, out, "labelled", "doc_id bigint, text string, label int")


@query("scan_documents", "SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark, d):
    return load_named(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("split_manifest", """
SELECT source AS split, COUNT(*) AS num_samples, CAST(SUM(length(text)) AS BIGINT) AS num_chars,
       'documents' AS dataset, false AS with_label_text
FROM documents GROUP BY source""")
def split_manifest(spark, d):
    docs = Tables(spark, d).documents.withColumnRenamed("source", "split")
    return CSV.manifest(docs, "documents").drop("files")


@query("summary_append", """
SELECT doc_id, quality, toxic FROM labels WHERE quality = 1
UNION ALL SELECT doc_id, quality, NULL AS toxic FROM labels WHERE quality <> 1""")
def summary_append(spark, d):
    lab = Tables(spark, d).labels
    old = lab.where(F.col("quality") == 1).select("doc_id", "quality", "toxic")
    new = lab.where(F.col("quality") != 1).select("doc_id", "quality")
    return P.union_tolerant(old, new)


@query("summary_versions", """
SELECT 1 AS version, doc_id, quality, toxic FROM labels WHERE quality = 1
UNION ALL SELECT 2, doc_id, quality, CASE WHEN quality = 1 THEN toxic END FROM labels
UNION ALL SELECT 3, doc_id, quality, CASE WHEN quality = 1 THEN toxic END FROM labels""")
def summary_versions(spark, d):
    """A stored summary that is appended to (the second time without a column) and rewritten; every version can be read."""
    lab = Tables(spark, d).labels
    path = scratch_dir(spark, "summary")
    V.append(lab.where(F.col("quality") == 1).select("doc_id", "quality", "toxic"), path)
    V.append(lab.where(F.col("quality") != 1).select("doc_id", "quality"), path)
    V.rewrite(spark, path)
    every = [V.read(spark, path, v).select(F.lit(v).alias("version"), "doc_id", "quality", "toxic") for v in V.versions(spark, path)]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("normalize_schema", """
SELECT d.text, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def normalize_schema(spark, d):
    t = Tables(spark, d)
    j = t.documents.join(t.labels, "doc_id")
    return P.normalize_schema(j, "text", "quality")


@query("label_text", """
SELECT doc_id, quality, CASE quality WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END AS label_text,
       CASE toxic WHEN 0 THEN 'clean' END AS toxic_text FROM labels""")
def label_text(spark, d):
    lab = Tables(spark, d).labels
    return lab.select("doc_id", "quality",
                      P.label_text(F.col("quality"), P.LABEL_MAPS["sst2"]).alias("label_text"),
                      P.label_text(F.col("toxic"), {0: "clean"}).alias("toxic_text"))


@query("cap_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def cap_rows(spark, d):
    return P.cap_rows(Tables(spark, d).documents.select("doc_id", "lang"), 100, ["doc_id"])


@query("contains_filter", "SELECT doc_id, source FROM documents WHERE contains(source, '1')")
def contains_filter(spark, d):
    hit, _ = P.split_by_contains(Tables(spark, d).documents.select("doc_id", "source"), "source", "1")
    return hit


@query("regex_extract_int", r"""
SELECT page_id, TRY_CAST(NULLIF(regexp_extract(url, '/[a-z]{2}/(\d+)', 1), '') AS INTEGER) AS page_no,
       TRY_CAST(NULLIF(regexp_extract(url, 'page=(\d+)', 1), '') AS INTEGER) AS param_page FROM pages""")
def regex_extract_int(spark, d):
    p = Tables(spark, d).pages
    return p.select("page_id", P.extract_int(F.col("url"), r"/[a-z]{2}/(\d+)").alias("page_no"),
                    P.extract_int(F.col("url"), r"page=(\d+)").alias("param_page"))


@query("keyword_filter", """
SELECT p_partkey, p_name, p_type FROM part
WHERE (contains(lower(p_name || ' ' || p_type), 'ring') OR contains(lower(p_name || ' ' || p_type), 'bolt')
       OR contains(lower(p_name || ' ' || p_type), 'gear'))
  AND NOT ends_with(lower(p_name || ' ' || p_type), 'economy')""")
def keyword_filter(spark, d):
    p = Tables(spark, d).part
    full = F.concat_ws(" ", "p_name", "p_type")
    return p.where(P.name_matches(full, ["ring", "bolt", "gear"], not_suffix="economy")).select("p_partkey", "p_name", "p_type")


@query("default_fields", """
SELECT d.doc_id, COALESCE(l.quality, -1) AS quality, COALESCE(l.toxic, -1) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def default_fields(spark, d):
    t = Tables(spark, d)
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.select("doc_id", P.with_default(F.col("quality"), -1).alias("quality"),
                    P.with_default(F.col("toxic"), -1).alias("toxic"))


@query("nested_json_field", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       json_extract_string(props, '$.z') AS z FROM events""")
def nested_json_field(spark, d):
    e = Tables(spark, d).events
    return e.select("event_id", P.json_field(F.col("props"), "$.k", "int").alias("k"),
                    P.json_field(F.col("props"), "$.z").alias("z"))


# Language code -> language name
LANGS = [("en", "English"), ("fr", "French"), ("de", "German"), ("es", "Spanish"), ("it", "Italian")]


@query("registry_join", """
SELECT d.lang, r.language, COUNT(*) AS n_docs FROM documents d
LEFT JOIN (VALUES ('en', 'English'), ('fr', 'French'), ('de', 'German'), ('es', 'Spanish'), ('it', 'Italian'))
  AS r(lang, language) ON d.lang = r.lang GROUP BY d.lang, r.language""")
def registry_join(spark, d):
    reg = spark.createDataFrame(LANGS, "lang string, language string")
    docs = Tables(spark, d).documents.select("lang")
    # the registry is a fixed five-row table: a proven size bound for broadcast
    return docs.join(F.broadcast(reg), "lang", "left").groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n_docs"))


CONFIG_LAYERS_SQL = """
SELECT n_nationkey, 1 AS lvl, 'lr' AS key, '2e-5' AS value FROM nation
UNION ALL SELECT n_nationkey, 1, 'epochs', '3' FROM nation
UNION ALL SELECT n_nationkey, 1, 'seed', '42' FROM nation
UNION ALL SELECT n_nationkey, 1, 'model', 'base' FROM nation
UNION ALL SELECT n_nationkey, 2, 'epochs', '5' FROM nation
UNION ALL SELECT n_nationkey, 2, 'rank', CASE WHEN n_regionkey = 0 THEN NULL ELSE '8' END FROM nation
UNION ALL SELECT n_nationkey, 2, 'dropout', '0.1' FROM nation
UNION ALL SELECT n_nationkey, 3, 'seed', CAST(n_nationkey AS VARCHAR) FROM nation
UNION ALL SELECT n_nationkey, 3, 'name', n_name FROM nation
UNION ALL SELECT n_nationkey, 3, 'dropout', CASE WHEN n_regionkey = 2 THEN NULL ELSE '0.05' END FROM nation
UNION ALL SELECT n_nationkey, 3, 'model', CASE WHEN n_regionkey = 3 THEN NULL ELSE 'distil' END FROM nation"""


@query("config_merge", f"""
SELECT n_nationkey, key, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY n_nationkey, key ORDER BY lvl DESC) AS rn FROM ({CONFIG_LAYERS_SQL}))
WHERE rn = 1 AND value IS NOT NULL""")
def config_merge(spark, d):
    n = Tables(spark, d).nation
    nul = F.lit(None).cast("string")
    g = F.create_map(F.lit("lr"), F.lit("2e-5"), F.lit("epochs"), F.lit("3"), F.lit("seed"), F.lit("42"),
                     F.lit("model"), F.lit("base"))
    b = F.create_map(F.lit("epochs"), F.lit("5"),
                     F.lit("rank"), F.when(F.col("n_regionkey") == 0, nul).otherwise(F.lit("8")),
                     F.lit("dropout"), F.lit("0.1"))
    e = F.create_map(F.lit("seed"), F.col("n_nationkey").cast("string"), F.lit("name"), F.col("n_name"),
                     F.lit("dropout"), F.when(F.col("n_regionkey") == 2, nul).otherwise(F.lit("0.05")),
                     F.lit("model"), F.when(F.col("n_regionkey") == 3, nul).otherwise(F.lit("distil")))
    m = n.select("n_nationkey", P.merge_config(g, b, e).alias("cfg"))
    return m.select("n_nationkey", F.explode("cfg").alias("key", "value"))


@query("run_timestamps", """
SELECT user_id, strftime(MIN(ts), '%Y-%m-%dT%H:%M:%S.%f') AS first_ts, strftime(MAX(ts), '%Y-%m-%dT%H:%M:%S.%f') AS last_ts,
       strftime(MIN(ts), '%Y%m%d_%H%M%S') AS stamp, ROUND(date_diff('microsecond', MIN(ts), MAX(ts)) / 1e6, 6) AS span_s
FROM events GROUP BY user_id""")
def run_timestamps(spark, d):
    e = Tables(spark, d).events
    g = e.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.select("user_id", P.iso_string(F.col("a")).alias("first_ts"), P.iso_string(F.col("b")).alias("last_ts"),
                    P.file_stamp(F.col("a")).alias("stamp"), F.round(P.seconds_between(F.col("a"), F.col("b")), 6).alias("span_s"))


def _doc_split():
    return (F.when(F.col("source").isin("src0", "src1", "src2"), "test")
             .when(F.col("source").isin("src3", "src4", "src5"), "validation").otherwise("train"))


@query("select_split", """
SELECT doc_id, source, split FROM (
  SELECT doc_id, source, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'test'
                              WHEN source IN ('src3', 'src4', 'src5') THEN 'validation' ELSE 'train' END AS split
  FROM documents) WHERE split = 'validation'""")
def select_split(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "source").withColumn("split", _doc_split())
    return S.select_split(docs, "validation")


@query("contains_first_match", """
WITH a AS (SELECT DISTINCT p_name FROM part),
b AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT DISTINCT lower(p_type) FROM part)
SELECT a.p_name, (SELECT MIN(w) FROM b WHERE contains(a.p_name, b.w) OR contains(b.w, a.p_name)) AS match FROM a""")
def contains_first_match(spark, d):
    p = Tables(spark, d).part
    words = (p.select(F.explode(F.split("p_name", " ")).alias("w"))
             .unionByName(p.select(F.lower("p_type").alias("w"))).distinct())
    return J.contains_first_match(p.select("p_name"), "p_name", words.withColumn("pos", F.col("w")), "w", "pos")


MODULES_SQL = """SELECT DISTINCT 'enc.layer.' || p_size || '.' || lower(p_type) || '.layer.' || (p_size // 10) || '.'
       || replace(p_name, ' ', '_') || '.weight' AS name FROM part"""


@query("layer_token_join", f"""
WITH m AS ({MODULES_SQL}),
g AS (SELECT p_size AS layer, 100 - p_size AS pos, COUNT(*) AS units FROM part GROUP BY p_size),
hits AS (SELECT m.name, g.layer, g.units, g.pos FROM m JOIN g ON contains(m.name, 'layer.' || g.layer || '.')
         WHERE contains(lower(m.name), 'small') OR contains(lower(m.name), 'large') OR contains(lower(m.name), 'promo'))
SELECT name, layer, units FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY pos DESC) AS rn FROM hits) WHERE rn = 1""")
def layer_token_join(spark, d):
    p = Tables(spark, d).part
    name = F.concat(F.lit("enc.layer."), F.col("p_size").cast("string"), F.lit("."), F.lower("p_type"), F.lit(".layer."),
                    F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), F.regexp_replace("p_name", " ", "_"),
                    F.lit(".weight"))
    mods = p.select(name.alias("name")).distinct()
    groups = p.groupBy(F.col("p_size").alias("layer")).agg(F.count(F.lit(1)).alias("units")).withColumn("pos", 100 - F.col("layer"))
    r = J.layer_token_join(mods, "name", groups, "layer", "pos", ["small", "large", "promo"], "units", out="units")
    return r.select("name", "layer", "units")


@query("unmatched_groups", """
SELECT source, COUNT(*) AS n_unlabelled FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source""")
def unmatched_groups(spark, d):
    t = Tables(spark, d)
    u = J.unmatched(t.documents.select("doc_id", "source"), t.labels.select("doc_id"), "doc_id")
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n_unlabelled"))


@query("match_audit", """
SELECT source, COUNT(*) FILTER (WHERE hit) AS n_matched, COUNT(*) FILTER (WHERE NOT hit) AS n_missing,
       (COUNT(*) FILTER (WHERE NOT hit) = 0 AND COUNT(*) FILTER (WHERE hit) >= 1) AS success
FROM (SELECT d.source, d.doc_id IN (SELECT doc_id FROM labels) AS hit FROM documents d) GROUP BY source""")
def match_audit(spark, d):
    t = Tables(spark, d)
    return J.match_audit(t.documents.select("doc_id", "source"), t.labels, "doc_id", "source")


@query("set_diff", """
(SELECT DISTINCT lang, 'second' AS missing_from FROM documents
 EXCEPT SELECT DISTINCT d.lang, 'second' FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)
UNION ALL
(SELECT DISTINCT d.lang, 'first' FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1
 EXCEPT SELECT DISTINCT lang, 'first' FROM documents)""")
def set_diff(spark, d):
    t = Tables(spark, d)
    tox = t.documents.join(t.labels.where(F.col("toxic") == 1), "doc_id")
    return P.set_diff(t.documents, tox, "lang")
