"""Queries of the duplicate operators (6 and 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import table
from tesserae.llm.near_duplicates import near_duplicates
from tesserae.llm.registry import query
from tesserae.llm.substrings import remove_repeats

SUBSTRINGS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS gram FROM s),
hot AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
cover AS (SELECT DISTINCT doc_id, i + k AS pos FROM g JOIN hot USING (gram), range(35) AS r(k)),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM w ANTI JOIN cover USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op9_substring_dedup", SUBSTRINGS_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=35)


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(ws[i : i + 3], ' ') FOR i IN range(1, greatest(len(ws) - 2, 2))]) AS set FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, len(set)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(set) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x AS a JOIN x AS b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""


@query("op6_minhash_near_dedup", NEAR_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, num=80, den=100)
