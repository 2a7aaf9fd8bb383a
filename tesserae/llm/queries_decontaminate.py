"""Query of the decontamination operator (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import table
from tesserae.llm.decontaminate import find_contamination
from tesserae.llm.registry import query

_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark),
bi AS (SELECT item, least(13, len(ws)) AS l, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, l, array_to_string(ws[i : i + l - 1], ' ') AS gram FROM bi),
di AS (SELECT doc_id, l, ws, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(ws) >= l),
dw AS (SELECT doc_id, l, i, array_to_string(ws[i : i + l - 1], ' ') AS gram FROM di),
h AS (SELECT doc_id, i, l, item FROM dw JOIN bw USING (l, gram)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, range(13) AS r(k) WHERE k < l GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
  sha256(coalesce(n.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op4_benchmark_decontamination", CONTAMINATION_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=13, share=20).drop("spans", "items")
