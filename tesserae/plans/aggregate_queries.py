"""Queries of aggregates, row-order windows, ordering and context assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.operators import context
from tesserae.plans.registry import query


@query("counts_of_tables", "SELECT (SELECT count(*) FROM source) AS sources, (SELECT count(*) FROM note) AS notes, (SELECT count(*) FROM source_insight) AS insights, (SELECT count(DISTINCT source) FROM source_embedding) AS embedded", "source", "note", "source_insight", "source_embedding")
def counts(c):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    embedded = c.source_embedding().agg(F.countDistinct("source").alias("embedded"))
    # Four rows of one aggregate each, side by side.
    return one(c.source(), "sources").join(one(c.note(), "notes")).join(one(c.source_insight(), "insights")).join(embedded)


@query("statistics_of_values", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def statistics(c):
    return c.raw("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("job_status_buckets", "SELECT CASE WHEN status IN ('running', 'processing') THEN 'running' WHEN status = 'completed' THEN 'completed' WHEN status IN ('failed', 'error') THEN 'failed' ELSE 'pending' END AS bucket, count(*) AS jobs, bool_or(status = 'running') AS any_active FROM command GROUP BY 1", "command")
def buckets(c):
    s = F.col("status")
    bucket = F.when(s.isin("running", "processing"), "running").when(s == "completed", "completed").when(s.isin("failed", "error"), "failed").otherwise("pending")
    return c.command().groupBy(bucket.alias("bucket")).agg(F.count("*").alias("jobs"), F.bool_or(s == "running").alias("any_active"))


@query("latest_status_of_jobs", "SELECT command, status, last_event FROM command", "command")
def latest(c):
    return c.command().select("command", "status", "last_event")


@query("job_progress", "SELECT command, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS done, round(count(*) FILTER (WHERE status = 'completed') / count(*) * 100, 2) AS percentage FROM job_event GROUP BY command", "job_event")
def progress(c):
    done = F.count_if(F.col("status") == "completed")
    return c.job_event().groupBy("command").agg(F.count("*").alias("total"), done.alias("done"), F.round(done / F.count("*") * 100, 2).alias("percentage"))


@query("kinds_in_lists", "SELECT note_type, count(*) AS n, sum(length(content)) AS chars, list_sort(list(DISTINCT title))[1:5] AS titles FROM note GROUP BY note_type", "note")
def kinds(c):
    sums = c.note().groupBy("note_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    first = F.row_number().over(Window.partitionBy("note_type").orderBy("title"))
    titles = c.note().select("note_type", "title").where("title IS NOT NULL").distinct().withColumn("r", first).where("r <= 5")
    titles = titles.groupBy("note_type").agg(F.sort_array(F.collect_list("title")).alias("titles"))
    joined = sums.join(F.broadcast(titles), sums["note_type"].eqNullSafe(titles["note_type"]), "left")
    return joined.select(sums["note_type"], "n", "chars", F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))


@query("json_field_sum", "SELECT user_id, sum(k) AS total FROM job_event GROUP BY user_id", "job_event")
def json_sum(c):
    return c.job_event().groupBy("user_id").agg(F.sum("k").alias("total"))


@query("last_row_by_key", "SELECT title, max_by(content, turn) AS content, max(updated) AS updated FROM note GROUP BY title", "note")
def last_row(c):
    return c.note().groupBy("title").agg(F.max_by("content", "turn").alias("content"), F.max("updated").alias("updated"))


_PARAGRAPHS = """
SELECT source, idx, page, element_type,
  CASE WHEN element_type IN ('paragraph', 'text') THEN count(*) FILTER (WHERE element_type IN ('paragraph', 'text')) OVER (PARTITION BY source, page ORDER BY idx) END AS paragraph_number,
  last_value(CASE WHEN element_type = 'section_header' THEN text END IGNORE NULLS) OVER (PARTITION BY source ORDER BY idx ROWS UNBOUNDED PRECEDING) AS chapter
FROM elements
"""


@query("paragraph_numbers_and_chapters", f"SELECT source, idx, page, element_type, paragraph_number, chapter FROM ({_PARAGRAPHS})", "elements")
def paragraphs(c):
    is_par = F.col("element_type").isin("paragraph", "text")
    before = lambda *keys: Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    number = F.when(is_par, F.count(F.when(is_par, 1)).over(before("source", "page")))
    chapter = F.last(F.when(F.col("element_type") == "section_header", F.col("text")), ignorenulls=True).over(before("source"))
    return c.elements().select("source", "idx", "page", "element_type", number.alias("paragraph_number"), chapter.alias("chapter"))


_BOXES = """
SELECT source, idx, round(least(greatest(box.l / 595, 0), 1), 6) AS x1, round(least(greatest(box.r / 595, 0), 1), 6) AS x2,
  round(least(greatest(least(CASE WHEN box.bottom_left THEN 842 - box.t ELSE box.t END, CASE WHEN box.bottom_left THEN 842 - box.b ELSE box.b END) / 842, 0), 1), 6) AS y1,
  round(least(greatest(greatest(CASE WHEN box.bottom_left THEN 842 - box.t ELSE box.t END, CASE WHEN box.bottom_left THEN 842 - box.b ELSE box.b END) / 842, 0), 1), 6) AS y2
FROM elements WHERE element_type <> 'table'
"""


@query("normalised_boxes", _BOXES, "elements")
def boxes(c):
    share = lambda x, size: F.round(F.least(F.greatest(x / size, F.lit(0.0)), F.lit(1.0)), 6)
    flip = lambda x: F.when(F.col("box.bottom_left"), 842 - F.col(f"box.{x}")).otherwise(F.col(f"box.{x}"))
    y = [F.least(flip("t"), flip("b")), F.greatest(flip("t"), flip("b"))]
    return c.elements().where("element_type <> 'table'").select("source", "idx", share(F.col("box.l"), 595).alias("x1"), share(F.col("box.r"), 595).alias("x2"), share(y[0], 842).alias("y1"), share(y[1], 842).alias("y2"))


_CONTEXT = """
WITH i AS (SELECT out AS grp, row_number() OVER (PARTITION BY out ORDER BY kind, id, twice) AS seq, id, kind AS type, tokens FROM (
  SELECT r.out, r."in" AS id, 'source' AS kind, floor(length(s.title) * 1.3)::BIGINT AS tokens, row_number() OVER (PARTITION BY r.out, r."in") AS twice FROM reference AS r JOIN source AS s ON s.id = r."in"
  UNION ALL SELECT a.out, a."in", 'note', floor(length(n.title) * 1.3)::BIGINT, 1 FROM artifact AS a JOIN note AS n ON n.id = a."in")),
f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY grp, id ORDER BY seq) = 1),
p AS (SELECT *, CASE type WHEN 'source' THEN 100 WHEN 'insight' THEN 75 WHEN 'note' THEN 50 ELSE 0 END AS priority FROM f),
w AS (SELECT *, sum(tokens) OVER (PARTITION BY grp ORDER BY priority DESC, seq ROWS UNBOUNDED PRECEDING) AS running FROM p)
SELECT grp, id, type, tokens, priority, running::BIGINT AS running FROM w WHERE running <= 300
"""


@query("context_within_budget", _CONTEXT, "source", "note", "reference", "artifact")
def context_budget(c):
    title = lambda df: df.select("id", F.floor(F.length("title") * F.lit(1.3)).cast("long").alias("tokens"))
    edges = c.reference().select("out", F.col("in").alias("id"), F.lit("source").alias("type")).join(title(c.source()), "id")
    edges = edges.unionByName(c.artifact().select("out", F.col("in").alias("id"), F.lit("note").alias("type")).join(title(c.note()), "id"))
    items = edges.withColumn("seq", F.row_number().over(Window.partitionBy("out").orderBy("type", "id"))).withColumnRenamed("out", "grp")
    return context.build_context(items, 300).select("grp", "id", "type", "tokens", "priority", "running")


@query("context_totals", _CONTEXT.replace("SELECT grp, id, type, tokens, priority, running::BIGINT AS running FROM w WHERE running <= 300", "SELECT grp, count(*) FILTER (WHERE type = 'source') AS sources, count(*) FILTER (WHERE type = 'note') AS notes, sum(tokens)::BIGINT AS tokens FROM w WHERE running <= 300 GROUP BY grp"), "source", "note", "reference", "artifact")
def context_totals(c):
    kept = context_budget(c)
    return kept.groupBy("grp").agg(F.count_if(F.col("type") == "source").alias("sources"), F.count_if(F.col("type") == "note").alias("notes"), F.sum("tokens").alias("tokens"))


@query("duplicate_name_suffix", "SELECT id, title || CASE WHEN row_number() OVER (PARTITION BY title ORDER BY id) > 1 THEN ' (' || (row_number() OVER (PARTITION BY title ORDER BY id) - 1) || ')' ELSE '' END AS name FROM note", "note")
def suffixes(c):
    n = F.row_number().over(Window.partitionBy("title").orderBy("id")) - 1
    return c.note().select("id", F.concat("title", F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise("")).alias("name"))


@query("first_box_on_page", "SELECT source, min((page, box.t)).page AS page, min((page, box.t)).t AS top FROM (SELECT source, page, box FROM elements) GROUP BY source".replace("min((page, box.t)).page", "min({'page': page, 't': box.t}).page").replace("min((page, box.t)).t", "min({'page': page, 't': box.t}).t"), "elements")
def first_box(c):
    least = c.elements().groupBy("source").agg(F.min(F.struct("page", F.col("box.t").alias("t"))).alias("m"))
    return least.select("source", F.col("m.page").alias("page"), F.col("m.t").alias("top"))


@query("tokens_and_cost", "SELECT id, floor(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) * 1.3)::BIGINT AS tokens, round(floor(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) * 1.3) * 0.15 / 1000000, 10) AS cost FROM note", "note")
def tokens(c):
    n = t.token_estimate(F.col("content"))
    return c.note().select("id", n.alias("tokens"), F.round(t.token_cost(n), 10).alias("cost"))
