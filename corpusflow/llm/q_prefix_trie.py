"""op11: the prefix trie of all rebuilt conversations."""

from __future__ import annotations

from corpusflow.llm.common import table
from corpusflow.llm.prefix_trie import prefix_trie, rebuilt
from corpusflow.llm.registry import query
from corpusflow.llm.sqlparts import crc32_sql

SQL = rf"""
WITH t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
            FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS rn FROM t0),
c AS (SELECT conv_id, {crc32_sql('conv_id::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, rn, digest, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND rn <= h
      UNION ALL SELECT c.conv_id, 1, rn, digest, words FROM c JOIN t ON t.conv_id = c.conv_id AND rn > h),
d AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS prefix, words FROM r
      WINDOW w AS (PARTITION BY conv_id ORDER BY own, rn ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, depth, md5(prefix) AS prefix, words FROM d UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM m GROUP BY depth, prefix),
p AS (SELECT n.*, up.prefix AS up FROM n LEFT JOIN m up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1),
k AS (SELECT depth - 1 AS depth, up AS prefix, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY 1, 2),
s AS (SELECT a.depth, a.prefix, sum(CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
             sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
      FROM n LEFT JOIN k USING (depth, prefix) JOIN m a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY 1, 2),
e AS (SELECT depth, prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM m JOIN l USING (conv_id, depth) GROUP BY 1, 2)
SELECT p.conv_id, p.depth, q.conv_id AS parent_conv_id, p.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM p LEFT JOIN n q ON q.depth = p.depth - 1 AND q.prefix = p.up LEFT JOIN k ON k.depth = p.depth AND k.prefix = p.prefix
JOIN s ON s.depth = p.depth AND s.prefix = p.prefix LEFT JOIN e ON e.depth = p.depth AND e.prefix = p.prefix
"""


@query("op11_prefix_trie", SQL)
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
