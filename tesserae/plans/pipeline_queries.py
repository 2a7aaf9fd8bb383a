"""Queries of composite steps: levels, messages, titles, renderings, estimates, recommendations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.plans.registry import query

_LEVELS = "CASE WHEN contains(lower(rule), 'not in') THEN 'off' WHEN contains(lower(rule), 'insights') THEN 'insights' WHEN contains(lower(rule), 'full content') THEN 'full' ELSE 'off' END"


@query("inclusion_levels", f"SELECT id, level FROM (SELECT id, {_LEVELS} AS level FROM (SELECT id, CASE updated % 4 WHEN 0 THEN 'not in context, insights' WHEN 1 THEN 'Insights only' WHEN 2 THEN 'full content' ELSE '' END AS rule FROM source)) WHERE level <> 'off'", "source")
def levels(c):
    u = F.col("updated") % 4
    rule = F.lower(F.when(u == 0, "not in context, insights").when(u == 1, "Insights only").when(u == 2, "full content").otherwise(""))
    level = F.when(rule.contains("not in"), "off").when(rule.contains("insights"), "insights").when(rule.contains("full content"), "full").otherwise("off")
    return c.source().select("id", level.alias("level")).where("level <> 'off'")


#: What each status is reported as.
_MESSAGES = "CASE status WHEN 'completed' THEN 'Source processing completed successfully' WHEN 'failed' THEN 'Source processing failed' WHEN 'running' THEN 'Source processing in progress' WHEN 'queued' THEN 'Source processing queued' WHEN 'unknown' THEN 'Source processing status unknown' ELSE 'Source processing status: ' || status END"


@query("status_messages", f"SELECT command, {_MESSAGES} AS message FROM command", "command")
def messages(c):
    s = F.col("status")
    said = F.when(s == "completed", "Source processing completed successfully").when(s == "failed", "Source processing failed").when(s == "running", "Source processing in progress").when(s == "queued", "Source processing queued").when(s == "unknown", "Source processing status unknown")
    return c.command().select("command", said.otherwise(F.concat(F.lit("Source processing status: "), s)).alias("message"))


@query("insight_note_titles", "SELECT i.id, i.insight_type || ' from source ' || s.title AS title, i.content FROM source_insight AS i JOIN source AS s ON s.id = i.source", "source", "source_insight")
def insight_notes(c):
    s = c.source().select(F.col("id").alias("source"), "title")
    return c.source_insight().join(s, "source").select("id", F.concat("insight_type", F.lit(" from source "), "title").alias("title"), "content")


@query("rebuild_estimate", "SELECT count(*) FILTER (WHERE full_text IS NOT NULL) AS sources, (SELECT count(*) FROM source_insight) AS insights, (SELECT count(*) FROM note WHERE length(trim(content)) > 0) AS notes, (SELECT count(DISTINCT source) FROM source_embedding) + (SELECT count(*) FROM note_vectors) + (SELECT count(*) FROM insight_vectors) AS embedded FROM source", "source", "source_insight", "note", "source_embedding", "note_vectors", "insight_vectors")
def estimate(c):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(c.source().where("full_text IS NOT NULL"), "sources"), one(c.source_insight(), "insights"), one(c.note().where(F.length(F.trim("content")) > 0), "notes")]
    parts += [c.source_embedding().agg(F.countDistinct("source").alias("a")), one(c.note_vectors(), "b"), one(c.insight_vectors(), "d")]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(p)
    return out.select("sources", "insights", "notes", (F.col("a") + F.col("b") + F.col("d")).alias("embedded"))


@query("rendered_source_context", "SELECT s.id, '## ' || s.title || chr(10) || 'Content: ' || CASE WHEN length(s.full_text) > 5000 THEN left(s.full_text, 5000) || '...' ELSE s.full_text END || coalesce(chr(10) || i.t, '') AS context FROM source AS s LEFT JOIN (SELECT source, string_agg('- ' || insight_type || ': ' || content, chr(10) ORDER BY insight_type) AS t FROM source_insight GROUP BY source) AS i ON i.source = s.id", "source", "source_insight")
def rendered(c):
    lines = F.transform(F.sort_array(F.collect_list(F.struct("insight_type", "content"))), lambda x: F.concat(F.lit("- "), x["insight_type"], F.lit(": "), x["content"]))
    insights = c.source_insight().groupBy(F.col("source").alias("id")).agg(F.array_join(lines, "\n").alias("t"))
    text = F.when(F.length("full_text") > 5000, F.concat(F.substring("full_text", 1, 5000), F.lit("..."))).otherwise(F.col("full_text"))
    s = c.source().join(insights, "id", "left")
    return s.select("id", F.concat(F.lit("## "), "title", F.lit("\nContent: "), text, F.coalesce(F.concat(F.lit("\n"), "t"), F.lit(""))).alias("context"))


@query("notebook_contents", "SELECT r.out AS notebook, count(*) AS n, sum(length(s.title)) AS chars, string_agg(s.title, '; ' ORDER BY s.title, s.id)[1:200] AS titles FROM (SELECT DISTINCT \"in\", out FROM reference) AS r JOIN source AS s ON s.id = r.\"in\" GROUP BY r.out", "source", "reference")
def contents(c):
    pairs = c.reference().distinct().join(c.source().select(F.col("id").alias("in"), "title"), "in")
    # Only the first titles are shown: each notebook's first sixty are kept before they are listed.
    counts = pairs.groupBy("out").agg(F.count("*").alias("n"), F.sum(F.length("title")).alias("chars"))
    first = pairs.withColumn("k", F.row_number().over(Window.partitionBy("out").orderBy("title", "in"))).where("k <= 60")
    shown = first.groupBy("out").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]), "; ").alias("t"))
    return counts.join(shown, "out").select(F.col("out").alias("notebook"), "n", "chars", F.substring("t", 1, 200).alias("titles"))


@query("collated_title_order", "SELECT id, title, note_type FROM note ORDER BY title COLLATE NOCASE, id", "note")
def places(c):
    return c.note().select("id", "title", "note_type").orderBy(F.expr("collate(title, 'UNICODE_CI')"), "id")


@query("commands_by_status", "SELECT status, command, count(*) OVER (PARTITION BY status) AS n FROM command", "command")
def by_status(c):
    counts = c.command().groupBy("status").agg(F.count("*").alias("n"))
    return c.command().select("status", "command").join(F.broadcast(counts), "status")


@query("chat_event_rows", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'ai_message' ELSE 'context_indicators' END AS event, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations")
def chat_events(c):
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "ai_message").otherwise("context_indicators")
    last = c.raw("conversations").groupBy("conv_id").agg(F.max("turn").alias("m"))
    return c.raw("conversations").join(last, "conv_id").select("conv_id", "turn", kind.alias("event"), (F.col("turn") == F.col("m")).alias("last"))


@query("most_linked_sources", "SELECT s.id, s.title, count(*) AS links FROM source AS s JOIN (SELECT out AS id FROM refers_to UNION ALL SELECT source FROM source_insight UNION ALL SELECT source FROM source_embedding) AS l USING (id) GROUP BY s.id, s.title ORDER BY links DESC, s.id LIMIT 30", "source", "source_insight", "source_embedding", "chat_session", "refers_to")
def most_linked(c):
    links = c.refers_to().select(F.col("out").alias("id")).unionAll(c.source_insight().select("source")).unionAll(c.source_embedding().select("source"))
    return c.source().select("id", "title").join(links.groupBy("id").agg(F.count("*").alias("links")), "id").orderBy(F.desc("links"), "id").limit(30)


@query("edge_strengths", "SELECT out, CASE WHEN k >= 60 THEN 'strong' WHEN k >= 40 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN k >= 60 THEN 1.0::DOUBLE WHEN k >= 40 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS weight FROM (SELECT out, count(*) AS k FROM reference GROUP BY out)", "reference")
def strengths(c):
    k = c.reference().groupBy("out").agg(F.count("*").alias("k"))
    return k.select("out", F.when(F.col("k") >= 60, "strong").when(F.col("k") >= 40, "moderate").otherwise("weak").alias("strength"), F.when(F.col("k") >= 60, 1.0).when(F.col("k") >= 40, 0.6).otherwise(0.3).alias("weight"))


@query("shared_notebook_recommendations", "SELECT n.\"in\" AS note, count(DISTINCT r.\"in\") AS sources FROM artifact AS n JOIN reference AS r ON r.out = n.out GROUP BY n.\"in\" HAVING count(DISTINCT r.\"in\") >= 10", "note", "artifact", "reference")
def shared(c):
    # Sources are counted once a notebook, not once a note.
    per = c.reference().groupBy("out").agg(F.countDistinct("in").alias("sources"))
    return c.artifact().join(per, "out").where("sources >= 10").select(F.col("in").alias("note"), "sources")
