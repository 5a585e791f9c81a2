"""op12: resampling of all documents towards the benchmark's word distribution."""

from __future__ import annotations

from corpusflow.llm.common import table
from corpusflow.llm.importance import resample
from corpusflow.llm.registry import query
from corpusflow.llm.sqlparts import crc32_sql

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest({WORDS}) AS w FROM benchmark),
terms AS (SELECT w, {crc32_sql('w')} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT b, count(*) AS s FROM dw JOIN terms USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN terms USING (w) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM dw) AS big_s, (SELECT count(*) FROM bw) AS big_t),
g AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000)::DOUBLE)
                                / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + 10000)::DOUBLE)))::BIGINT AS gain
      FROM (SELECT DISTINCT b FROM terms) LEFT JOIN s USING (b) LEFT JOIN t USING (b), n),
w AS (SELECT r, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS weight FROM dw JOIN terms USING (w) JOIN g USING (b) GROUP BY r),
z AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                         / 4294967296::DOUBLE))))::BIGINT AS score
      FROM d LEFT JOIN w USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rk,
             10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS draw FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND rk <= draw THEN rk END::BIGINT AS rank FROM k
"""


@query("op12_importance_resampling", SQL)
def op12_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")
