"""op5: remove lines that stand on ten or more sources, keeping their first occurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.llm.common import table
from corpusflow.llm.line_dedup import remove_boilerplate
from corpusflow.llm.registry import query

MIN_SITES = 10

SQL = rf"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS pos FROM rows WHERE text IS NOT NULL),
b AS (SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
      GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
f AS (SELECT line, min((doc_id, pos)) AS first FROM l JOIN b USING (line) GROUP BY line),
m AS (SELECT l.*, f.line IS NOT NULL AND (l.doc_id, l.pos) <> f.first AS gone FROM l LEFT JOIN f USING (line)),
k AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM m GROUP BY rid)
SELECT r.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, k.text
FROM rows r LEFT JOIN k USING (rid)
"""


@query("op5_line_dedup", SQL)
def op5_line_dedup(spark, sf_dir):
    out = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), min_sites=MIN_SITES)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.col("row.text").alias("text"))
