"""Queries of names, references, chunk mappings, contexts, vectorising, notes and search entry points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.functions.markdown import to_markdown
from tesserae.functions.split import split_text
from tesserae.operators import context, ingest, search
from tesserae.operators.parsed import parsed_chunks
from tesserae.operators.running import ranked
from tesserae.plans.registry import query
from tesserae.plans.search_queries import _COS, _LEGS, _SOURCE, _text_sql, _vector_legs, _vector_sql, text_index


@query("output_names", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y%m%d_%H%M%S') || '_a.b.pdf' WHEN 1 THEN strftime(ts, '%Y-%m-%d') || '_a.b.pdf' WHEN 2 THEN 'a.b_' || strftime(ts, '%Y%m%d_%H%M%S') || '.pdf' ELSE 'a.b.pdf' END AS name, 'My_doc__1__' || strftime(ts, '%Y%m%d_%H%M%S') AS folder FROM events")
def names(c):
    scheme = F.element_at(F.array(*map(F.lit, ("timestamp_prefix", "date_prefix", "datetime_suffix", "original"))), (F.col("event_id") % 4 + 1).cast("int"))
    at = F.col("ts").cast("timestamp")
    return c.raw("events").select("event_id", t.output_name(F.lit("a.b.pdf"), scheme, at).alias("name"), F.concat(t.safe_name(F.lit("My doc (1)")), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss")).alias("folder"))


#: Fixed value: the line that a consolidated document begins with, after its title.
_INTRO = "This document consolidates all content from the {} documentation folder."
_TITLED = "upper(left({x}, 1)) || substr({x}, 2)"
_FOLDER = f"""
WITH f AS (SELECT DISTINCT r.out, replace(r.out, 'notebook:', '') AS folder, s.id, replace(s.title, '-', ' ') AS stem, s.title, s.full_text FROM reference AS r JOIN source AS s ON s.id = r."in" WHERE lower(s.title) <> 'index')
SELECT folder, 0 AS place, '# ' || {_TITLED.format(x="replace(folder, '-', ' ')")} || chr(10) || chr(10) || '{_INTRO.replace("{}", "' || folder || '")}' || chr(10) || chr(10) || '---' AS section FROM (SELECT DISTINCT folder FROM f)
UNION ALL SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY title, id), '## ' || {_TITLED.format(x="stem")} || chr(10) || chr(10) || '*Source: ' || title || '.md*' || chr(10) || chr(10) || coalesce(full_text, '') || chr(10) || chr(10) || '---' FROM f
"""


@query("consolidated_folders", _FOLDER, "reference", "source")
def folders(c):
    """Each notebook's document as its sections in order, whole texts: a title with an introduction, then a section for each source."""
    titled = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    spaced = lambda x: F.regexp_replace(x, "-", " ")
    s = c.source().where(F.lower("title") != "index").select(F.col("id").alias("in"), "title")
    files = c.reference().distinct().join(s, "in").select(F.regexp_replace("out", "notebook:", "").alias("folder"), "title", "in")
    placed = ranked(files, ["folder"], [F.asc("title"), F.asc("in")], "place").join(c.source().select(F.col("id").alias("in"), "full_text"), "in")
    section = F.concat(F.lit("## "), titled(spaced(F.col("title"))), F.lit("\n\n*Source: "), "title", F.lit(".md*\n\n"), F.coalesce("full_text", F.lit("")), F.lit("\n\n---"))
    before, after = _INTRO.split("{}")
    heads = files.select("folder").distinct().select("folder", F.lit(0).cast("long").alias("place"), F.concat(F.lit("# "), titled(spaced(F.col("folder"))), F.lit("\n\n" + before), "folder", F.lit(after + "\n\n---")).alias("section"))
    return placed.select("folder", F.col("place").cast("long").alias("place"), section.alias("section")).unionByName(heads)


@query("event_lines_read_back", "SELECT event_id, event_type AS type, user_id AS user FROM events")
def read_back(c):
    """Lines of two events each, the second cut short: the whole one is read, the partial last line waits."""
    one = t.event_line(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")))
    sent = c.raw("events").select("event_id", F.concat(one, F.lit('data: {"type":"cu')).alias("buffer"))
    lines = sent.select("event_id", F.split("buffer", "\n\n").alias("l"))
    whole = lines.select("event_id", F.explode(F.slice("l", F.lit(1), F.size("l") - 1)).alias("line")).where(F.col("line").startswith("data: "))
    return whole.select("event_id", F.from_json(F.substring("line", 7, 1 << 30), "type string, user bigint").alias("e")).select("event_id", "e.type", "e.user")


_PLACED = "SELECT id, 'source' AS kind, substr(source, 8) AS key, source AS ref, (length(id) + 11)::INT AS start, (length(id) + 11 + length(source))::INT AS after FROM source_insight UNION ALL SELECT id, 'source_insight', substr(id, 16), id, 5, (5 + length(id))::INT FROM source_insight"


@query("placed_references", _PLACED, "source_insight")
def placed(c):
    said = F.concat(F.lit("see ["), "id", F.lit("] and "), "source", F.lit(", not x:1"))
    return c.source_insight().select("id", F.explode(t.placed_references(said)).alias("r")).select("id", "r.kind", "r.key", "r.ref", "r.start", "r.after")


@query("wrapped_reference_links", "SELECT id, 'a [[[' || id || ']]](#ref-' || replace(id, ':', '-') || ') b [[' || id || ']](#ref-' || replace(id, ':', '-') || ') c [[**' || id || '**]](#ref-' || replace(id, ':', '-') || ') d [**' || id || '**](#ref-' || replace(id, ':', '-') || ') e [' || id || '](#ref-' || replace(id, ':', '-') || ')' AS linked FROM note", "note")
def wrapped(c):
    said = F.concat(F.lit("a [["), "id", F.lit("]] b ["), "id", F.lit("] c [**"), "id", F.lit("**] d **"), "id", F.lit("** e "), "id")
    return c.note().select("id", t.wrapped_reference_links(said).alias("linked"))


@query("process_text_or_error", "SELECT id, CASE turn % 5 WHEN 0 THEN upper(title) WHEN 1 THEN lower(title) WHEN 2 THEN reverse(title) WHEN 3 THEN '2' END AS result, CASE WHEN turn % 5 = 4 THEN 'unknown operation: shout' END AS error FROM note", "note")
def process(c):
    done = {"uppercase": F.upper("title"), "lowercase": F.lower("title"), "reverse": F.reverse("title"), "word_count": t.word_count(F.col("title")).cast("string")}
    asked = F.element_at(F.array(*map(F.lit, (*done, "shout"))), (F.col("turn") % 5 + 1).cast("int"))
    result = F.coalesce(*(F.when(F.col("operation") == name, value) for name, value in done.items()))
    return c.note().withColumn("operation", asked).select("id", result.alias("result"), F.when(~F.col("operation").isin(*done), F.concat(F.lit("unknown operation: "), "operation")).alias("error"))


_MERGED = """
SELECT source, idx // 4 AS "order", min(page) AS physical_page, min(page) + 1 AS printed_page, max(page) AS last_page, min_by(text, idx) FILTER (WHERE element_type = 'section_header') AS chapter, 'chunk' AS element_type,
  count(*) FILTER (WHERE box IS NOT NULL) AS num_locations, list_sort(list(DISTINCT round(least(greatest(box.l / 595, 0), 1), 6))) AS lefts FROM elements GROUP BY source, idx // 4
"""


@query("merged_chunks", _MERGED, "elements")
def merged(c):
    """Chunks of four elements each: the first page counts, the printed one is the next, the first heading is the chapter."""
    e = c.elements().withColumn("order", F.floor(F.col("idx") / 4))
    left = F.round(F.least(F.greatest(F.col("box.l") / 595, F.lit(0.0)), F.lit(1.0)), 6)
    return e.groupBy("source", "order").agg(
        F.min("page").alias("physical_page"), (F.min("page") + 1).alias("printed_page"), F.max("page").alias("last_page"), F.min_by("text", F.when(F.col("element_type") == "section_header", F.col("idx"))).alias("chapter"),
        F.lit("chunk").alias("element_type"), F.count("box").alias("num_locations"), F.sort_array(F.collect_set(left)).alias("lefts"),
    )


_TOKENS_OF = "floor(len(list_filter(string_split_regex(coalesce({c}, ''), '\\s+'), lambda x: x <> '')) * 1.3)::BIGINT"
_ITEMS = f"""
SELECT out AS grp, id, type, tokens, row_number() OVER (PARTITION BY out ORDER BY k, id) AS seq FROM (
  SELECT DISTINCT r.out, s.id, 'source' AS type, 1 AS k, {_TOKENS_OF.format(c='s.full_text')} AS tokens FROM reference AS r JOIN source AS s ON s.id = r."in"
  UNION ALL SELECT DISTINCT r.out, i.id, 'insight', 2, {_TOKENS_OF.format(c='i.content')} FROM reference AS r JOIN source_insight AS i ON i.source = r."in"
  UNION ALL SELECT a.out, n.id, 'note', 3, {_TOKENS_OF.format(c='n.content')} FROM artifact AS a JOIN note AS n ON n.id = a."in")
"""
_WHOLE = f"WITH i AS ({_ITEMS}), w AS (SELECT *, sum(tokens) OVER (PARTITION BY grp ORDER BY CASE type WHEN 'source' THEN 100 WHEN 'insight' THEN 75 ELSE 50 END DESC, seq ROWS UNBOUNDED PRECEDING) AS running FROM i) SELECT grp, id, type, tokens, running::BIGINT AS running FROM w WHERE running <= 2000"


@query("notebook_context_with_insights", _WHOLE, "source", "source_insight", "note", "reference", "artifact")
def whole_context(c):
    """Sources, their insights and notes of each notebook by priority, with the tokens of their contents, within a budget."""
    tokens = lambda df, col: df.withColumn("tokens", t.token_estimate(F.col(col))).drop(col)
    links = c.reference().distinct()
    s = tokens(c.source().select(F.col("id").alias("in"), "full_text"), "full_text")
    i = tokens(c.source_insight().select(F.col("source").alias("in"), "id", "content"), "content")
    n = tokens(c.note().select(F.col("id").alias("in"), "content"), "content")
    kind = lambda df, k, name, key: df.select(F.col("out").alias("grp"), F.lit(k).alias("k"), F.col(key).alias("id"), F.lit(name).alias("type"), "tokens")
    items = kind(links.join(s, "in"), 1, "source", "in").unionAll(kind(links.join(i, "in"), 2, "insight", "id")).unionAll(kind(c.artifact().join(n, "in"), 3, "note", "in"))
    return context.build_context(items.withColumn("seq", F.struct("k", "id")).drop("k"), 2000).select("grp", "id", "type", "tokens", "running")


_WANTED = "SELECT * FROM (VALUES ('source:3', 'full content'), ('source:4', 'insights only'), ('source:5', 'not in context'), ('source:none', 'full content'), ('6', 'full content')) AS w(id, rule)"


@query("explicit_context", f"SELECT s.id, CASE WHEN contains(w.rule, 'insights') THEN 'insights' ELSE 'full' END AS level, CASE WHEN contains(w.rule, 'full content') THEN {_TOKENS_OF.format(c='s.full_text')} ELSE coalesce((SELECT sum({_TOKENS_OF.format(c='i.content')}) FROM source_insight AS i WHERE i.source = s.id), 0) END::BIGINT AS tokens FROM ({_WANTED}) AS w JOIN source AS s ON s.id = CASE WHEN w.id LIKE 'source:%' THEN w.id ELSE 'source:' || w.id END WHERE NOT contains(w.rule, 'not in')", "source", "source_insight")
def explicit(c):
    """The stated ids at their levels; ids may lack their prefix, unknown ones are left out."""
    wanted = c.spark.createDataFrame([("source:3", "full content"), ("source:4", "insights only"), ("source:5", "not in context"), ("source:none", "full content"), ("6", "full content")], "id string, rule string")
    wanted = wanted.where(~F.col("rule").contains("not in")).select(t.with_prefix(F.col("id"), "source").alias("id"), F.when(F.col("rule").contains("insights"), "insights").otherwise("full").alias("level"))
    s = c.source().select("id", "full_text").join(F.broadcast(wanted), "id")
    i = c.source_insight().join(F.broadcast(wanted.select(F.col("id").alias("source"))), "source").groupBy(F.col("source").alias("id")).agg(F.sum(t.token_estimate(F.col("content"))).alias("k"))
    return s.join(i, "id", "left").select("id", "level", F.when(F.col("level") == "full", t.token_estimate(F.col("full_text"))).otherwise(F.coalesce("k", F.lit(0))).alias("tokens"))


def vectorised(c, sources, old):
    """The old chunks of these sources are gone; their texts' chunks, in order, are there. An empty text leaves none."""
    fresh = sources.select(F.col("id").alias("source"), F.posexplode(split_text("full_text")).alias("order", "content"))
    kept = old.join(sources.select(F.col("id").alias("source")), "source", "left_anti").select("source", "order", "content")
    return kept.unionByName(fresh.select("source", F.col("order").cast("long").alias("order"), "content"))


_SHORT = "SELECT id, full_text FROM source WHERE updated % 2 = 0 AND floor(len(list_filter(string_split_regex(full_text, '\\s+'), lambda x: x <> '')) * 1.3) <= 500"
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The splitter's rules: parts are measured with the separators at their heads, so a text of at most 500 tokens may have several chunks.
_VECTORISED = rf"""
WITH RECURSIVE short AS MATERIALIZED ({_SHORT}), marks AS (SELECT [chr(10) || chr(10), chr(10), '.', ',', ' ', chr(8203), chr(65292), chr(12289), chr(65294), chr(12290), ''] AS m),
w AS (SELECT id, []::BIGINT[] AS path, full_text AS part, 1::BIGINT AS level, 500::BIGINT AS n FROM short
  UNION ALL SELECT id, list_append(path, i), x, k + 1, floor(len(list_filter(string_split_regex(x, '{_WHITE}+'), lambda y: y <> '')) * 1.3)::BIGINT FROM (
    SELECT id, path, k, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM (
      SELECT id, path, k, list_filter(CASE WHEN m[k] = '' THEN string_split(part, '') ELSE list_prepend(string_split(part, m[k])[1], list_transform(string_split(part, m[k])[2:], lambda y: m[k] || y)) END, lambda y: y <> '') AS parts
      FROM (SELECT w.*, m, list_min(list_filter(range(level, 12), lambda j: m[j] = '' OR contains(part, m[j]))) AS k FROM w, marks WHERE n >= 500 AND level <= 11)))),
r AS (SELECT id, path[:-2] AS parent, path, part, n, n >= 500 AND level <= 11 AS cut, count(*) FILTER (WHERE n >= 500 AND level <= 11) OVER (PARTITION BY id, path[:-2] ORDER BY path) AS run FROM w WHERE len(path) > 0),
l AS MATERIALIZED (SELECT id, min(path) AS path, list(part ORDER BY path) AS parts, list_prepend(0::BIGINT, list(total ORDER BY path)) AS p FROM (SELECT *, (sum(n) OVER (PARTITION BY id, parent, run ORDER BY path))::BIGINT AS total FROM r WHERE NOT cut) GROUP BY id, parent, run),
g AS (SELECT *, 1::BIGINT AS s, coalesce(list_min(list_filter(range(2, len(parts) + 1), lambda e: p[e + 1] > 500)), len(parts) + 1) AS e FROM l
  UNION ALL SELECT id, path, parts, p, f, coalesce(list_min(list_filter(range(f + 1, len(parts) + 1), lambda j: p[j + 1] - p[f] > 500)), len(parts) + 1) FROM (
    SELECT id, path, parts, p, list_min(list_filter(range(s, e + 1), lambda f: p[e] - p[f] <= 75 AND (p[e] = p[f] OR p[e + 1] - p[f] <= 500))) AS f FROM g WHERE e <= len(parts))),
c AS (SELECT id, path, s, regexp_replace(array_to_string(parts[s:e - 1], ''), '^{_WHITE}+|{_WHITE}+$', '', 'g') AS content FROM g)
SELECT e.source, e."order", e.content FROM source_embedding AS e WHERE e.source NOT IN (SELECT id FROM short)
UNION ALL SELECT id, row_number() OVER (PARTITION BY id ORDER BY path, s) - 1, content FROM c WHERE content <> ''
"""


@query("vectorise_short_sources", _VECTORISED, "source", "source_embedding")
def vectorise(c):
    short = c.source().where((F.col("updated") % 2 == 0) & (t.token_estimate(F.col("full_text")) <= 500)).select("id", "full_text")
    return vectorised(c, short, c.source_embedding().select("source", "order", "content"))


@query("chunk_counts_after_vectorising", "SELECT id AS source, (full_text IS NOT NULL AND trim(full_text) <> '') AS some FROM source", "source")
def chunk_counts(c):
    """Which sources have chunks after all are split; how many is the splitter's matter, which the tests hold to its rules."""
    n = vectorised(c, c.source().select("id", "full_text"), c.source_embedding().select("source", "order", "content")).groupBy(F.col("source").alias("id")).count()
    return c.source().select("id").join(n, "id", "left").select(F.col("id").alias("source"), F.col("count").isNotNull().alias("some"))


@query("add_insight_with_checks", "SELECT id, CASE WHEN kind IS NULL THEN 'no type' WHEN length(trim(content)) = 0 THEN 'no content' END AS problem FROM (SELECT id, CASE WHEN turn % 4 = 0 THEN NULL ELSE note_type END AS kind, CASE WHEN turn % 4 = 1 THEN ' ' ELSE content END AS content FROM note)", "note")
def add_insight(c):
    kind, content = F.when(F.col("turn") % 4 != 0, F.col("note_type")), F.when(F.col("turn") % 4 == 1, " ").otherwise(F.col("content"))
    return c.note().select("id", F.when(kind.isNull(), "no type").when(F.length(F.trim(content)) == 0, "no content").alias("problem"))


@query("rebuild_outcomes", "SELECT kind, count(*) AS total, count(*) FILTER (WHERE ok) AS done, count(*) FILTER (WHERE NOT ok) AS failed, round(count(*) FILTER (WHERE ok) / count(*) * 100, 2) AS percentage FROM (SELECT 'source' AS kind, coalesce(length(trim(full_text)), 0) > 0 AS ok FROM source UNION ALL SELECT 'note', coalesce(length(trim(content)), 0) > 20 FROM note UNION ALL SELECT 'insight', source NOT LIKE 'source:gone%' FROM source_insight) GROUP BY kind", "source", "note", "source_insight")
def outcomes(c):
    long = lambda col, n: F.coalesce(F.length(F.trim(col)), F.lit(0)) > n
    each = c.source().select(F.lit("source").alias("kind"), long("full_text", 0).alias("ok")).unionAll(c.note().select(F.lit("note"), long("content", 20))).unionAll(c.source_insight().select(F.lit("insight"), ~F.col("source").startswith("source:gone")))
    done = F.count_if("ok")
    return each.groupBy("kind").agg(F.count("*").alias("total"), done.alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.round(done / F.count("*") * 100, 2).alias("percentage"))


@query("new_notes", "SELECT id, CASE WHEN title IS NULL AND note_type = 'ai' AND content <> '' THEN left(content, 15) ELSE title END AS title, note_type, 'notebook:src' || (conv_id % 20) AS out FROM (SELECT id, CASE WHEN turn % 2 = 0 THEN title END AS title, content, note_type, conv_id FROM note)", "note")
def new_notes(c):
    """Notes with their edge; an AI note without a title gets one made of its content (here its first letters)."""
    title = F.when(F.col("turn") % 2 == 0, F.col("title"))
    made = F.when(title.isNull() & (F.col("note_type") == "ai") & (F.col("content") != ""), F.substring("content", 1, 15)).otherwise(title)
    return c.note().select("id", made.alias("title"), "note_type", F.concat(F.lit("notebook:src"), (F.col("conv_id") % 20).cast("string")).alias("out"))


_EVENTS = """
SELECT conv_id, place, event FROM (SELECT conv_id, 0 AS place, 'strategy' AS event FROM chat_session UNION ALL SELECT conv_id, turn + 1, 'answer' FROM note WHERE note_type = 'ai'
UNION ALL SELECT conv_id, max(turn) + 2, 'final_answer' FROM note GROUP BY conv_id HAVING count(*) > 1 UNION ALL SELECT conv_id, max(turn) + 3, CASE WHEN count(*) > 1 THEN 'complete' ELSE 'error' END FROM note GROUP BY conv_id)
"""


@query("ask_event_stream", _EVENTS, "chat_session", "note")
def ask_events(c):
    """Each question's events in order: the strategy, its answers, the final answer, and completion or an error."""
    ends = c.note().groupBy("conv_id").agg(F.max("turn").alias("last"), F.count("*").alias("n"))
    ok = F.col("n") > 1
    event = lambda df, place, name: df.select("conv_id", place.cast("long").alias("place"), name.alias("event"))
    rows = event(ends, F.lit(0), F.lit("strategy")).unionAll(event(c.note().where("note_type = 'ai'"), F.col("turn") + 1, F.lit("answer")))
    return rows.unionAll(event(ends.where(ok), F.col("last") + 2, F.lit("final_answer"))).unionAll(event(ends, F.col("last") + 3, F.when(ok, "complete").otherwise("error")))


@query("highlighted_titles", "SELECT id, regexp_replace(content, '(?i)\\b(label|the)\\b', '`\\1`', 'g') AS shown FROM source_insight", "source_insight")
def highlight(c):
    return c.source_insight().select("id", search.highlighted(F.col("content"), ["label", "the"]).alias("shown"))


@query("search_text_entry", f"SELECT id, parent_id, title, relevance, relevance AS final_score FROM ({_text_sql(_LEGS, ['label', 'is'], 100)})", "source", "source_embedding", "source_insight", "note")
def text_entry(c):
    return search.search("text", " Label is ", text_index(c)).withColumns({"relevance": F.round("relevance", 6), "final_score": F.round("final_score", 6)})


@query("search_vector_entry", f"SELECT id, parent_id, title, similarity, matches, similarity AS final_score FROM ({_vector_sql(100, 0.2)})", "source", "source_embedding", "source_insight", "insight_vectors", "note", "note_vectors")
def vector_entry(c):
    embed = lambda keyword: [float(x) for x in c.raw("embeddings").where("vec_id = 0").select("embedding").first()[0]]
    return search.search("vector", "first vector", None, _vector_legs(c), embed).withColumns({"similarity": F.round("similarity", 6), "final_score": F.round("final_score", 6)})


@query("picker_search", f"SELECT parent_id AS id, coalesce(title, 'Untitled') AS title FROM ({_text_sql([(_SOURCE, 'title'), (_SOURCE, 'full_text')], ['that'], 100)})", "source")
def picker(c):
    found = text_index(c).search("that", 100, ["source_title", "source_text"])
    return found.select(F.col("parent_id").alias("id"), F.coalesce("title", F.lit("Untitled")).alias("title"))


@query("source_list_page", "SELECT s.id, s.title, s.updated, coalesce(i.k, 0) AS insights_count, e.source IS NOT NULL AS embedded FROM (SELECT * FROM source ORDER BY updated DESC, id LIMIT 20 OFFSET 20) AS s LEFT JOIN (SELECT source, count(*) AS k FROM source_insight GROUP BY source) AS i ON i.source = s.id LEFT JOIN (SELECT DISTINCT source FROM source_embedding) AS e ON e.source = s.id", "source", "source_insight", "source_embedding")
def list_page(c):
    """One page of sources; only its rows meet the counts."""
    page = F.broadcast(c.source().select("id", "title", "updated").orderBy(F.desc("updated"), "id").offset(20).limit(20))
    on_page = lambda df: df.select(F.col("source").alias("id")).join(page.select("id"), "id", "left_semi")
    insights = on_page(c.source_insight()).groupBy("id").agg(F.count("*").alias("k"))
    embedded = on_page(c.source_embedding()).distinct().withColumn("e", F.lit(True))
    return page.join(insights, "id", "left").join(embedded, "id", "left").select("id", "title", "updated", F.coalesce("k", F.lit(0)).alias("insights_count"), F.col("e").isNotNull().alias("embedded"))


@query("notebook_content_text", "SELECT out AS notebook, row_number() OVER (PARTITION BY out ORDER BY id) AS place, to_json({'id': id, 'title': title}) AS content FROM (SELECT DISTINCT r.out, s.id, s.title FROM reference AS r JOIN source AS s ON s.id = r.\"in\")", "reference", "source")
def content_text(c):
    """Each notebook's content line by line: a notebook may hold too much for one row."""
    s = c.source().select(F.col("id").alias("in"), "title")
    each = c.reference().distinct().join(s, "in").select(F.col("out").alias("notebook"), F.col("in").alias("id"), F.to_json(F.struct(F.col("in").alias("id"), "title")).alias("content"))
    return ranked(each, ["notebook"], [F.asc("id")], "place").select("notebook", F.col("place").cast("long").alias("place"), "content")


@query("answers_of_search_terms", f"SELECT q.vec_id AS term, e.id, {_COS.replace('embedding', 'e.embedding').replace('q::', 'q.embedding::')} AS similarity FROM source_embedding AS e, (SELECT * FROM embeddings WHERE vec_id < 5) AS q WHERE {_COS.replace('embedding', 'e.embedding').replace('q::', 'q.embedding::')} >= 0.2 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, e.id) <= 10", "source_embedding")
def answers(c):
    """At most five stated search terms, each with its ten most similar chunks of at least the default similarity."""
    q = [(r.vec_id, [float(x) for x in r.embedding]) for r in c.raw("embeddings").where("vec_id < 5").select("vec_id", "embedding").collect()]  # five rows
    legs = [search.vector_leg(c.source_embedding().select(F.col("id").alias("row_id"), "embedding"), v, 10, 0.2).select(F.lit(k).cast("long").alias("term"), F.col("row_id").alias("id"), "similarity") for k, v in q]
    out = legs[0]
    for leg in legs[1:]:
        out = out.unionAll(leg)
    return out


_ITEM = """
SELECT 'source:' || doc_id AS id, i, text, i // 4 + 1 + (i % 5 = 0)::INT AS last_page, CASE WHEN i % 10 = 9 THEN 'table' WHEN i % 10 = 7 THEN 'picture' WHEN i % 10 = 6 THEN 'formula' ELSE ['section_header', 'paragraph', 'text', 'title', 'paragraph', 'caption'][i % 6 + 1] END AS kind,
  CASE WHEN i % 10 IN (6, 7, 9) THEN NULL WHEN i % 6 IN (0, 3) THEN text END AS heading,
  CASE WHEN i % 10 = 9 THEN '| line | text |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || i || ' | ' || text || ' |' WHEN i % 10 = 7 AND i % 4 <> 3 THEN '[Picture ' || i || ']' ELSE text END AS said
FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents)
"""
_PARSED = f"""
WITH x AS (SELECT id, i, said, kind, CASE WHEN i % 7 = 3 THEN 0 ELSE last_page END AS page, last_value(heading IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS chapter FROM ({_ITEM})),
y AS (SELECT *, CASE WHEN kind IN ('paragraph', 'text') THEN count(*) FILTER (WHERE kind IN ('paragraph', 'text')) OVER (PARTITION BY id, page ORDER BY i ROWS UNBOUNDED PRECEDING) END AS paragraph_number FROM x WHERE trim(said, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
p AS (SELECT id, i, unnest(CASE WHEN i % 7 = 3 THEN [] WHEN i % 5 = 0 THEN [i // 4 + 1, i // 4 + 2] ELSE [i // 4 + 1] END) AS page FROM y),
q AS (SELECT id, i, page, CASE WHEN page % 2 = 1 AND page < 100 THEN page + 600 ELSE 595 END AS w, CASE WHEN page % 2 = 1 AND page < 100 THEN 800 ELSE 842 END AS h FROM p),
s AS (SELECT id, i, sum(round(page + least(i * 10 % 600 / w, 1) + 3 * least((i * 10 % 600 + 100) / w, 1) + 5 * greatest(0, least(1, CASE WHEN i % 2 = 0 OR i % 3 <> 0 THEN h - i * 20 % 850 - 15 ELSE i * 20 % 850 END / h)) + 7 * greatest(0, least(1, CASE WHEN i % 2 = 0 OR i % 3 <> 0 THEN h - i * 20 % 850 ELSE i * 20 % 850 + 15 END / h)), 6)) AS places, count(*) AS n FROM q GROUP BY id, i)
SELECT y.id, y.i AS "order", y.said AS text, y.kind AS element_type, y.chapter, y.page AS physical_page, y.page AS printed_page, y.paragraph_number, coalesce(s.n, 0) AS num_locations, round(coalesce(s.places, 0), 5) AS places FROM y LEFT JOIN s USING (id, i)
"""


@query("parsed_document_chunks", _PARSED)
def parsed_documents(c):
    """Chunks of nested items; the five numbers of their places are compared as one weighted sum of each item."""
    weighted = F.aggregate("positions", F.lit(0.0), lambda s, p: s + F.round(p[0] + p[1] + 3 * p[2] + 5 * p[3] + 7 * p[4], 6))
    return parsed_chunks(c.parsed()).select(
        "id", F.col("order").cast("long").alias("order"), "text", "element_type", "chapter", F.col("physical_page").cast("long").alias("physical_page"), F.col("printed_page").cast("long").alias("printed_page"),
        "paragraph_number", F.size("positions").cast("long").alias("num_locations"), F.round(weighted, 5).alias("places"),
    )


@query("pages_to_markdown")
def pages(c):
    """Whole pages as markdown; see the tests, SQL has no reader of tags."""
    return c.raw("pages").select("page_id", "url", to_markdown(F.col("html")).alias("markdown"))


@query("ingested_pages")
def ingest_pages(c):
    """All pages to sources, chunks with vectors and insights, by stated stand-ins of the models; see the tests."""
    embed = lambda text: F.array(F.length(text).cast("double"), t.word_count(text).cast("double"))
    made = ingest.ingested(c.raw("pages").select(F.col("page_id").cast("string").alias("id"), "html"), {"opening": lambda text: F.substring(text, 1, 200), "shouted": F.upper}, embed)
    row = lambda df, kind, owner, place, text: df.select(F.lit(kind).alias("kind"), F.col(owner).alias("source"), place.alias("place"), F.col(text).alias("text"))
    sources = row(made["sources"], "source", "id", F.lit(0).cast("long"), "full_text")
    return sources.unionAll(row(made["chunks"], "chunk", "source", F.col("order"), "content")).unionAll(row(made["insights"], "insight", "source", F.lit(0).cast("long"), "content"))
