"""Query of the conversation trie (13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import table
from tesserae.llm.conversations import conversation_trie
from tesserae.llm.crc_sql import TABLE, crc32
from tesserae.llm.registry import query

# A prefix is the digests of its turns in order.
TRIE_SQL = f"""
WITH {TABLE},
o AS (SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, strlen(coalesce(text, '')) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, n, c - c % 5 AS base, {crc32("s")} % 9 AS h FROM (SELECT c, max(i) AS n, c::VARCHAR AS s FROM o GROUP BY c), crc),
k AS (SELECT h.c, h.h, h.n, count(o.i) AS skip FROM h LEFT JOIN o ON o.c = h.base AND o.i <= h.h GROUP BY ALL),
r AS (SELECT h.c, o.i AS d, o.t, o.b FROM h JOIN o ON o.c = h.base AND o.i <= h.h UNION ALL SELECT o.c, o.i - k.h + k.skip, o.t, o.b FROM o JOIN k USING (c) WHERE o.i > k.h),
p AS (SELECT c, d, string_agg(t, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS name, b FROM r UNION ALL SELECT c, 0, '', 0 FROM k),
n AS (SELECT name, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs, max(b) AS b FROM p GROUP BY name),
x AS (SELECT n.*, a.name AS parent, q.conv_id AS parent_conv_id FROM n LEFT JOIN p AS a ON a.c = n.conv_id AND a.d = n.depth - 1 LEFT JOIN n AS q ON q.name = a.name),
y AS (SELECT x.*, coalesce(z.n, 0) AS n_children FROM x LEFT JOIN (SELECT parent, count(*) AS n FROM x GROUP BY parent) AS z ON z.parent = x.name),
s AS (SELECT p.name, sum((y.n_children = 0)::INT) AS n_leaves, sum((y.n_convs - 1) * y.b) AS saved FROM y JOIN p ON p.c = y.conv_id AND p.d <= y.depth GROUP BY p.name),
e AS (SELECT p.name, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ends FROM p JOIN k ON k.c = p.c AND p.d = k.skip + greatest(k.n - k.h, 0) GROUP BY p.name)
SELECT y.conv_id, y.depth::BIGINT AS depth, y.parent_conv_id, y.n_convs, y.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM y JOIN s USING (name) LEFT JOIN e USING (name)
"""


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
