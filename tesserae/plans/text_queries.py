"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.functions.split import split_text, splitter
from tesserae.functions.tokens import ModelTokens
from tesserae.functions.versions import compare_versions
from tesserae.plans.registry import query


@query("remove_non_ascii", "SELECT id, regexp_replace(content, '[^\\x00-\\x7F]+', '', 'g') AS content FROM note", "note")
def non_ascii(c):
    return c.note().select("id", t.remove_non_ascii(F.col("content")).alias("content"))


_PRINTABLE = r"""
SELECT id, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(full_text, '[\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), '[\x{2028}\x{2029}\r]', chr(10), 'g'), '[^\P{C}\n\t]', '', 'g'), chr(160), ' '), '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}_\s.,!?\-]', '', 'g') AS text FROM source
"""


@query("remove_non_printable", _PRINTABLE, "source")
def non_printable(c):
    return c.source().select("id", t.remove_non_printable(F.col("full_text")).alias("text"))


_THINK = r"""
WITH m AS (SELECT id, CASE WHEN turn % 3 = 0 THEN '<think> about ' || title || chr(10) || '</think>' || content || '<think>again</think>' ELSE content END AS t FROM note)
SELECT id, CASE WHEN len(regexp_extract_all(t, '(?s)<think>(.*?)</think>', 1)) > 0 THEN array_to_string([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN regexp_extract_all(t, '(?s)<think>(.*?)</think>', 1)], chr(10) || chr(10)) ELSE '' END AS thinking,
  CASE WHEN len(regexp_extract_all(t, '(?s)<think>(.*?)</think>', 1)) > 0 THEN regexp_replace(regexp_replace(regexp_replace(t, '(?s)<think>(.*?)</think>', '', 'g'), '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') ELSE t END AS cleaned FROM m
"""


@query("parse_thinking", _THINK, "note")
def thinking(c):
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think> about "), "title", F.lit("\n</think>"), "content", F.lit("<think>again</think>"))).otherwise(F.col("content"))
    m = c.note().select("id", said.alias("t"))
    block, rest = t.parse_thinking(F.col("t"))
    return m.select("id", block.alias("thinking"), rest.alias("cleaned"))


@query("case_reverse_count", "SELECT id, upper(title) AS up, lower(title) AS low, reverse(title) AS back, len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> ''))::INT AS words FROM note", "note")
def process_text(c):
    return c.note().select("id", F.upper("title").alias("up"), F.lower("title").alias("low"), F.reverse("title").alias("back"), t.word_count(F.col("content")).alias("words"))


_REFS = "SELECT id, unnest(regexp_extract_all('see [' || id || '] and ' || source || ', not x:1', '(source_insight|note|source):([a-zA-Z0-9_]+)')) AS ref FROM source_insight"


@query("reference_extraction", _REFS, "source_insight")
def refs(c):
    said = F.concat(F.lit("see ["), "id", F.lit("] and "), "source", F.lit(", not x:1"))
    return c.source_insight().select("id", F.explode(t.references(said)).alias("ref"))


_LINKS = r"SELECT id, regexp_replace(regexp_replace('see [' || id || '] and ' || source, '\[\[?(source_insight|note|source):([a-zA-Z0-9_]+)\]?\]', '\1:\2', 'g'), '(source_insight|note|source):([a-zA-Z0-9_]+)', '[\1:\2](#ref-\1-\2)', 'g') AS linked FROM source_insight"


@query("reference_links", _LINKS, "source_insight")
def links(c):
    return c.source_insight().select("id", t.linked_references(F.concat(F.lit("see ["), "id", F.lit("] and "), "source")).alias("linked"))


@query("event_stream_lines", "SELECT event_id, 'data: {\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' || chr(10) || chr(10) AS line FROM events")
def lines(c):
    return c.raw("events").select("event_id", t.event_line(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("line"))


@query("string_lists_and_flags", "SELECT id, [trim(x) FOR x IN string_split(title || ' , ' || name, ',')] AS parts, lower(CASE WHEN archived THEN 'Yes' ELSE 'no' END) IN ('true', '1', 'yes', 'on') AS flag, regexp_replace(name || ' é!.md', '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe FROM (SELECT *, name AS title FROM notebook)", "notebook")
def lists(c):
    n = c.notebook()
    flag = t.truthy(F.when(F.col("archived"), "Yes").otherwise("no"))
    return n.select("id", t.comma_list(F.concat("name", F.lit(" , "), "name")).alias("parts"), flag.alias("flag"), t.safe_name(F.concat("name", F.lit(" é!.md"))).alias("safe"))


@query("page_text_without_tags", "SELECT page_id, url, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS n FROM pages")
def page_text(c):
    return c.raw("pages").select("page_id", "url", F.length(F.regexp_replace("html", "<[^>]*>", " ")).alias("n"))


@query("recursive_chunks")
def chunks(c):
    """Chunks of at most 500 tokens with their order; no SQL, the tests hold them to an independent splitter."""
    return c.source().select("id", F.posexplode(split_text("full_text")).alias("order", "chunk"))


def _model(c) -> ModelTokens:
    import public_tokenizers

    return ModelTokens(c.spark, f"file://{public_tokenizers.path('byte_bpe_50k.tiktoken')}", public_tokenizers.PATTERN)


@query("model_token_counts")
def model_tokens(c):
    """Tokens of each source's text by a byte-pair vocabulary, and what they cost; no SQL, see the tests."""
    counted = c.source().select("id", _model(c).column(F.col("full_text")).alias("tokens"))
    return counted.select("id", "tokens", t.token_cost(F.col("tokens")).alias("cost"))


@query("chunks_by_model_tokens")
def model_chunks(c):
    """Chunks of at most 500 of the vocabulary's tokens with their order; no SQL, see the tests."""
    chunks = splitter(_model(c).count)
    return c.source().select("id", F.posexplode(chunks("full_text")).alias("order", "chunk"))


@query("compare_versions", "SELECT id, CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS compared FROM (SELECT id, [created % 7, updated % 5] AS a, [created % 3, updated % 11] AS b FROM source)", "source")
def versions(c):
    v = lambda a, b: F.concat((F.col("created") % a).cast("string"), F.lit("."), (F.col("updated") % b).cast("string"))
    return c.source().select("id", compare_versions(v(7, 5), v(3, 11)).alias("compared"))
