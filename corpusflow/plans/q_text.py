"""Text cleaning, encoding, profiles and noise queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.functions.hashing import sql_row_hash32, sql_sub_uniform
from corpusflow.operators import encode as EN
from corpusflow.operators import noise as NZ
from corpusflow.operators.ranks import global_rank, ntile_from_rank
from corpusflow.operators.sampling import assign_batches
from corpusflow.plans.registry import query
from corpusflow.sources.tables import Tables

SEED = 42
WORDS_SQL = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
TOKS_SQL = r"regexp_extract_all({c}, '[^ \t\n\r]+')"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# the references that the pages hold, with their texts; the ampersand last, so that nothing is decoded twice
PAGE_REFERENCES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _unescape_sql(c: str) -> str:
    for ref, text in PAGE_REFERENCES:
        c = f"replace({c}, {_sql_str(ref)}, {_sql_str(text)})"
    return c


def _u_sql(seed, *keys: str) -> str:
    k = " || '|' || ".join(f"CAST({x} AS VARCHAR)" for x in keys)
    return f"(('0x' || substr(md5('{seed}|' || {k}), 1, 8))::BIGINT / 4294967296.0)"


def _tok_u(seed, key_sql: str, i_sql: str) -> str:
    """Per-token draw: row md5 hash mixed with the 0-based token index."""
    return sql_sub_uniform(sql_row_hash32(seed, key_sql), i_sql)


@query("html_unescape", f"SELECT page_id, {_unescape_sql('html')} AS text_out FROM pages")
def html_unescape(spark, d):
    return Tables(spark, d).pages.select("page_id", X.html_unescape(F.col("html")).alias("text_out"))


@query("html_unescape_full", f"SELECT page_id, {_unescape_sql('html')} AS text_out FROM pages")
def html_unescape_full(spark, d):
    """T1 under its earlier name, by the native decoder."""
    return Tables(spark, d).pages.select("page_id", X.html_unescape_full(F.col("html")).alias("text_out"))


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text_out FROM pages")
def strip_tags(spark, d):
    return Tables(spark, d).pages.select("page_id", X.strip_tags(F.col("html")).alias("text_out"))


@query("mask_urls", r"SELECT page_id, regexp_replace(html, 'http\S+|www.\S+', '[URL]', 'g') AS text_out FROM pages")
def mask_urls(spark, d):
    return Tables(spark, d).pages.select("page_id", X.mask_urls(F.col("html")).alias("text_out"))


@query("mask_users", r"SELECT doc_id, regexp_replace(text, '@[\p{L}\p{N}_]+', '[USER]', 'g') AS text_out FROM documents")
def mask_users(spark, d):
    return Tables(spark, d).documents.select("doc_id", X.mask_users(F.col("text")).alias("text_out"))


@query("squash_ws", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text_out FROM documents")
def squash_ws(spark, d):
    return Tables(spark, d).documents.select("doc_id", X.squash_ws(F.col("text")).alias("text_out"))


CLEAN_SQL = ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _unescape_sql("html")
             + r", '<[^>]+>', '', 'g'), 'http\S+|www.\S+', '[URL]', 'g'), '@[\p{L}\p{N}_]+', '[USER]', 'g'), '\s+', ' ', 'g'))")


@query("clean_text", f"SELECT page_id, {CLEAN_SQL} AS text_out FROM pages")
def clean_text(spark, d):
    return Tables(spark, d).pages.select("page_id", X.clean_text(F.col("html")).alias("text_out"))


def vocab_sql(size: int) -> str:
    return f"""SELECT term, n, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, term) + 1 AS INTEGER) AS id FROM (
  SELECT term, COUNT(*) AS n FROM (SELECT UNNEST({WORDS_SQL.format(c='text')}) AS term FROM documents) GROUP BY term)
  ORDER BY n DESC, term LIMIT {size}"""


@query("build_vocab", f"SELECT term, id, n FROM ({vocab_sql(1000)})")
def build_vocab(spark, d):
    return EN.build_vocab(Tables(spark, d).documents, "text", 1000).select("term", "id", "n")


def encode_sql(L: int, vocab: int) -> str:
    return f"""
WITH v AS ({vocab_sql(vocab)}),
w AS (SELECT doc_id, {WORDS_SQL.format(c='text')}[1:{L}] AS w FROM documents),
e AS (SELECT doc_id, UNNEST(w) AS term, UNNEST(range(len(w))) AS pos FROM w),
ids AS (SELECT e.doc_id, list(COALESCE(v.id, 1) ORDER BY e.pos) AS ids FROM e LEFT JOIN v ON e.term = v.term GROUP BY e.doc_id),
enc AS (SELECT d.doc_id, COALESCE(ids.ids, []::INTEGER[]) AS ids FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id)"""


@query("encode_fixed", encode_sql(32, 1000) + """
SELECT doc_id, array_to_string(list_resize(ids, 32, 0), ',') AS input_ids,
       array_to_string(list_resize(list_transform(ids, lambda x: 1), 32, 0), ',') AS attention_mask,
       CAST(len(ids) AS INTEGER) AS n_tokens FROM enc""")
def encode_fixed(spark, d):
    t = Tables(spark, d)
    v = EN.build_vocab(t.documents, "text", 1000)
    e = EN.encode(t.documents, "doc_id", "text", v, 32)
    return e.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("attention_mask", ",").alias("attention_mask"), "n_tokens")


@query("format_for_training", encode_sql(32, 1000) + """
SELECT array_to_string(list_resize(ids, 32, 0), ',') AS input_ids,
       array_to_string(list_resize(list_transform(ids, lambda x: 1), 32, 0), ',') AS attention_mask,
       l.quality AS labels FROM enc JOIN labels l ON enc.doc_id = l.doc_id""")
def format_for_training(spark, d):
    from corpusflow.operators.schema import keep_model_columns, rename_label
    t = Tables(spark, d)
    v = EN.build_vocab(t.documents, "text", 1000)
    e = EN.encode(t.documents, "doc_id", "text", v, 32).join(t.labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    e = keep_model_columns(rename_label(e, "label"), "labels")
    return e.select(F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("attention_mask", ",").alias("attention_mask"), "labels")


@query("length_profile", f"""
SELECT lang, COUNT(*) AS n_docs, ROUND(AVG(n), 6) AS mean_tokens,
       ROUND(AVG(CASE WHEN n > 128 THEN 1.0 ELSE 0.0 END), 6) AS truncated_share
FROM (SELECT lang, len({WORDS_SQL.format(c='text')}) AS n FROM documents) GROUP BY lang""")
def length_profile(spark, d):
    p = EN.length_profile(Tables(spark, d).documents, "lang", "text", 128)
    return p.select("lang", "n_docs", F.round("mean_tokens", 6).alias("mean_tokens"),
                    F.round("truncated_share", 6).alias("truncated_share"))


@query("oov_ratio", f"""
WITH v AS ({vocab_sql(1000)}),
e AS (SELECT doc_id, UNNEST({WORDS_SQL.format(c='text')}) AS term FROM documents),
r AS (SELECT e.doc_id, AVG(CASE WHEN v.term IS NULL THEN 1.0 ELSE 0.0 END) AS oov FROM e LEFT JOIN v ON e.term = v.term GROUP BY e.doc_id)
SELECT d.doc_id, ROUND(r.oov, 6) AS oov_ratio FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id""")
def oov_ratio(spark, d):
    t = Tables(spark, d)
    v = EN.build_vocab(t.documents, "text", 1000)
    r = EN.oov_ratio(t.documents, "doc_id", "text", v)
    return r.select("doc_id", F.round("oov_ratio", 6).alias("oov_ratio"))


@query("dynamic_padding", f"""
SELECT batch_id, COUNT(*) AS n_rows, MAX(n) AS padded_len,
       ROUND(CASE WHEN MAX(n) > 0 THEN 1 - SUM(n) / (MAX(n) * COUNT(*)) END, 6) AS waste_share FROM (
  SELECT CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY md5('{SEED}|' || CAST(doc_id AS VARCHAR)), doc_id) - 1) / 8) AS BIGINT) AS batch_id,
         CAST(LEAST(len({WORDS_SQL.format(c='text')}), 128) AS INTEGER) AS n FROM documents) GROUP BY batch_id""")
def dynamic_padding(spark, d):
    docs = Tables(spark, d).documents.withColumn("n_tokens", F.least(X.n_words(F.col("text")), F.lit(128)))
    b = assign_batches(docs.select("doc_id", "n_tokens"), 8, SEED, "doc_id")
    p = EN.pad_to_batch_max(b, "batch_id")
    return p.select("batch_id", "n_rows", "padded_len", F.round("waste_share", 6).alias("waste_share"))


@query("padded_batches", encode_sql(128, 1000) + f""",
b AS (SELECT doc_id, ids, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY md5('{SEED}|' || CAST(doc_id AS VARCHAR)), doc_id) - 1) / 8) AS BIGINT) AS batch_id FROM enc),
m AS (SELECT *, MAX(len(ids)) OVER (PARTITION BY batch_id) AS padded_len FROM b)
SELECT doc_id, batch_id, CAST(len(ids) AS INTEGER) AS n_tokens, CAST(padded_len AS INTEGER) AS padded_len,
       array_to_string(list_resize(ids, padded_len, 0), ',') AS input_ids,
       array_to_string(list_resize(list_transform(ids, lambda x: 1), padded_len, 0), ',') AS attention_mask FROM m""")
def padded_batches(spark, d):
    """Every row of a batch padded to the batch's longest, with its mask."""
    t = Tables(spark, d)
    v = EN.build_vocab(t.documents, "text", 1000)
    e = EN.encode_ragged(t.documents, "doc_id", "text", v, 128)
    p = EN.pad_batches(assign_batches(e, 8, SEED, "doc_id").drop("sample_rank"), "batch_id")
    return p.select("doc_id", "batch_id", "n_tokens", "padded_len", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("attention_mask", ",").alias("attention_mask"))


BINS = ["easy", "medium", "hard"]


@query("length_tertiles", f"""
SELECT doc_id, n_tokens, tertile, CASE tertile WHEN 1 THEN 'easy' WHEN 2 THEN 'medium' ELSE 'hard' END AS bin FROM (
  SELECT doc_id, n_tokens, CAST(NTILE(3) OVER (ORDER BY n_tokens, doc_id) AS INTEGER) AS tertile FROM (
    SELECT doc_id, CAST(len({WORDS_SQL.format(c='text')}) AS INTEGER) AS n_tokens FROM documents))""")
def length_tertiles(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", X.n_words(F.col("text")).alias("n_tokens"))
    r = global_rank(docs, ["n_tokens"], "doc_id")
    n = docs.agg(F.count(F.lit(1)).alias("_N"))
    r = r.crossJoin(F.broadcast(n))  # one-row table
    r = r.withColumn("tertile", ntile_from_rank(F.col("rank"), F.col("_N"), 3))
    m = F.create_map(*[x for i, b in enumerate(BINS) for x in (F.lit(i + 1), F.lit(b))])
    return r.select("doc_id", "n_tokens", "tertile", F.element_at(m, F.col("tertile")).alias("bin"))


@query("label_noise", f"""
SELECT doc_id, quality AS label,
       CAST(CASE WHEN {_u_sql(SEED, 'doc_id')} < 0.1
                 THEN (quality + 1 + CAST(FLOOR({_u_sql(f'{SEED}:2', 'doc_id')} * 1) AS INTEGER)) % 2
                 ELSE quality END AS INTEGER) AS noisy_label FROM labels""")
def label_noise(spark, d):
    lab = Tables(spark, d).labels.select("doc_id", F.col("quality").alias("label"))
    return NZ.flip_labels(lab, "label", "doc_id", 0.1, 2, SEED)


@query("word_drop", f"""
SELECT doc_id, array_to_string(list_filter({TOKS_SQL.format(c='text')},
       lambda w, i: {_tok_u(SEED, 'doc_id', 'i - 1')} >= 0.1), ' ') AS text_out FROM documents""")
def word_drop(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")
    return NZ.drop_words(docs, "text", "doc_id", 0.1, SEED).select("doc_id", "text_out")


@query("typo_noise", f"""
SELECT doc_id, array_to_string(list_transform(t, lambda w, i: CASE
  WHEN {_tok_u(SEED, 'doc_id', 'i - 1')} < 0.1 AND length(w) >= 2 THEN
    substring(w, 1, j(w, i)) || substring(w, j(w, i) + 2, 1) || substring(w, j(w, i) + 1, 1) || substring(w, j(w, i) + 3, 1073741824)
  ELSE w END), ' ') AS text_out
FROM (SELECT doc_id, {TOKS_SQL.format(c='text')} AS t FROM documents)""".replace(
    "j(w, i)", f"CAST(FLOOR({_tok_u(f'{SEED}:pos', 'doc_id', 'i - 1')} * (length(w) - 1)) AS INTEGER)"))
def typo_noise(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")
    return NZ.typos(docs, "text", "doc_id", 0.1, SEED).select("doc_id", "text_out")


# words of the paraphrase cache
CACHE_WORDS = 2000


@query("synonym_replace", f"""
WITH v AS ({vocab_sql(CACHE_WORDS)}),
e AS (SELECT doc_id, UNNEST(t) AS tok, UNNEST(range(len(t))) AS pos FROM (SELECT doc_id, {TOKS_SQL.format(c='text')} AS t FROM documents)),
m AS (SELECT *, '{NZ.MARKS}' AS marks FROM e),
r AS (SELECT m.doc_id, string_agg(CASE WHEN v.term IS NOT NULL AND {_tok_u(SEED, 'm.doc_id', 'm.pos')} < 0.3
                                       THEN left(m.tok, length(m.tok) - length(ltrim(m.tok, marks))) || v.term || '~syn'
                                            || right(m.tok, length(m.tok) - length(rtrim(m.tok, marks)))
                                       ELSE m.tok END, ' ' ORDER BY m.pos) AS text_out
      FROM m LEFT JOIN v ON lower(trim(m.tok, marks)) = v.term GROUP BY m.doc_id)
SELECT d.doc_id, COALESCE(r.text_out, '') AS text_out FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id""")
def synonym_replace(spark, d):
    t = Tables(spark, d)
    v = EN.build_vocab(t.documents, "text", CACHE_WORDS)
    # the cache stands for a table of paraphrases
    cache = v.select("term", F.concat("term", F.lit("~syn")).alias("replacement"))
    return NZ.replace_from_cache(t.documents.select("doc_id", "text"), "text", "doc_id", cache, 0.3, SEED)

