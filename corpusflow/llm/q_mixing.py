"""op4: mix all documents to target weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.llm.common import table
from corpusflow.llm.mixing import mix_sources
from corpusflow.llm.registry import query

SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 16) AS h
  FROM documents),
s AS (SELECT sk, sum(size)::BIGINT AS source_size FROM d GROUP BY sk),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY sk) - 1) % 3] AS wt,
             2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())
                 - coalesce(sum(cap) OVER (ORDER BY cap / wt, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(wt) OVER (ORDER BY cap / wt, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT sk, source_size, least(cap::DOUBLE, wt * max(lv) OVER ()) AS target FROM l),
q AS (SELECT *, round(target)::BIGINT AS quota FROM t),
r AS (SELECT d.*, q.source_size, q.target, q.quota,
             CASE WHEN q.source_size > 0 THEN q.quota // q.source_size ELSE 0 END AS epochs,
             coalesce(sum(d.size) OVER (PARTITION BY d.sk ORDER BY d.h, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre
      FROM d JOIN q USING (sk))
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, quota - epochs * source_size - pre)))::BIGINT AS taken
FROM r
"""


@query("op4_mix_sources", SQL)
def op4_mix_sources(spark, sf_dir):
    m = mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return m.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")
