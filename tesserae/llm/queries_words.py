"""Query of spelling variants (12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import table
from tesserae.llm.crc_sql import TABLE, crc32
from tesserae.llm.registry import query
from tesserae.llm.spelling import noisy_words, spelling_variants

# Words near each other share what is left without one letter, at one place (replaced), or one is what is left of the other.
VARIANTS_SQL = rf"""
WITH RECURSIVE {TABLE},
r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, k, {crc32("s")} AS h FROM (SELECT run, k, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM r), crc),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS other FROM d AS a JOIN d AS b USING (i, rest) WHERE a.word <> b.word UNION SELECT d.word, w.word FROM d JOIN w ON w.word = d.rest UNION SELECT w.word, d.word FROM d JOIN w ON w.word = d.rest),
b AS (SELECT p.word, count(*) AS n_near, min((-o.n, o.word)) AS best FROM p JOIN w AS o ON o.word = p.other GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, c.next, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL
"""


@query("op12_spelling_variants", VARIANTS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(noisy_words(table(spark, sf_dir, "documents")))
