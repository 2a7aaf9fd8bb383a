"""Queries of scans, projections, filters, row changes and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.operators import graph, rows
from tesserae.plans.registry import query


@query("scan_notebooks_ordered", "SELECT id, name, archived, updated FROM notebook ORDER BY updated DESC, id", "notebook")
def scan_notebooks(c):
    return c.notebook().orderBy(F.desc("updated"), "id")


@query("point_lookup_source", "SELECT id, title, topics[1] AS topic, updated FROM source WHERE id = 'source:7'", "source")
def lookup(c):
    return rows.point_lookup(c.source(), "id", "source:7").select("id", "title", F.col("topics")[0].alias("topic"), "updated")


@query("notebooks_not_archived", "SELECT id, name FROM notebook WHERE NOT archived", "notebook")
def not_archived(c):
    return c.notebook().where("NOT archived").select("id", "name")


@query("notebook_name_contains", "SELECT id, name FROM notebook WHERE contains(lower(name), lower(trim(' SRC1 ')))", "notebook")
def name_contains(c):
    return c.notebook().where(F.lower("name").contains(" SRC1 ".strip().lower())).select("id", "name")


@query("omit_wide_columns", "SELECT id, title, command, updated, created FROM source", "source")
def omit(c):
    return c.source().drop("full_text", "topics")


@query("insight_title_concat", "SELECT i.id, i.insight_type || ' - ' || coalesce(s.title, '') AS title FROM source_insight AS i LEFT JOIN source AS s ON s.id = i.source", "source_insight", "source")
def insight_title(c):
    i, s = c.source_insight(), c.source().select(F.col("id").alias("source"), "title")
    return i.join(s, "source", "left").select("id", F.concat("insight_type", F.lit(" - "), F.coalesce("title", F.lit(""))).alias("title"))


@query("update_merge_keeps_nulls", "SELECT n.id, CASE WHEN n.updated % 2 = 0 THEN 'renamed ' || n.name ELSE n.name END AS name, n.archived, CASE WHEN n.updated % 2 = 0 THEN 99 ELSE n.updated END AS updated FROM notebook AS n", "notebook")
def update_merge(c):
    n = c.notebook()
    changes = n.where("updated % 2 = 0").select("id", F.concat(F.lit("renamed "), "name").alias("name"), F.lit(None).cast("boolean").alias("archived"), F.lit(99).cast("long").alias("updated"))
    return rows.update_merge(n, changes)


_UPSERT = """
SELECT coalesce(n.id, u.id) AS id, coalesce(u.name, n.name) AS name, n.archived, coalesce(u.updated, n.updated) AS updated
FROM notebook AS n FULL JOIN (SELECT id || CASE WHEN updated % 2 = 0 THEN '' ELSE '_new' END AS id, upper(name) AS name, 1::BIGINT AS updated FROM notebook WHERE updated < 9) AS u ON u.id = n.id
"""


@query("upsert_merge", _UPSERT, "notebook")
def upsert(c):
    n = c.notebook()
    changes = n.where("updated < 9").select(F.concat("id", F.when(F.col("updated") % 2 == 0, "").otherwise("_new")).alias("id"), F.upper("name").alias("name"), F.lit(1).cast("long").alias("updated"))
    return rows.upsert_merge(n, changes)


@query("insert_ignoring_duplicates", "SELECT id, name FROM notebook UNION ALL SELECT id || '_copy', name || ' - Copy' FROM notebook WHERE NOT archived", "notebook")
def insert_ignoring(c):
    n = c.notebook().select("id", "name")
    copies = c.notebook().where("NOT archived").select(F.concat("id", F.lit("_copy")).alias("id"), F.concat("name", F.lit(" - Copy")).alias("name"))
    return rows.insert_ignoring_duplicates(n, copies.unionByName(n))


@query("insert_batch_or_nothing", "SELECT 'clash' AS batch, id, name FROM notebook UNION ALL SELECT 'new', id, name FROM notebook UNION ALL SELECT 'new', id || '_b', name FROM notebook", "notebook")
def insert_batch(c):
    n = c.notebook().select("id", "name")
    clash = n.select(F.when(F.col("name") == "src0", F.col("id")).otherwise(F.concat("id", F.lit("_b"))).alias("id"), "name")
    fresh = n.select(F.concat("id", F.lit("_b")).alias("id"), "name")
    tried = lambda batch, kind: rows.insert_batch_or_nothing(n, batch).select(F.lit(kind).alias("batch"), "id", "name")
    return tried(clash, "clash").unionAll(tried(fresh, "new"))


@query("cascade_delete_sources", "SELECT 'insight' AS kind, count(*) AS n FROM source_insight WHERE NOT (source IN (SELECT id FROM source WHERE updated < 300)) UNION ALL SELECT 'embedding', count(*) FROM source_embedding WHERE NOT (source IN (SELECT id FROM source WHERE updated < 300)) UNION ALL SELECT 'source', count(*) FROM source WHERE NOT updated < 300", "source", "source_insight", "source_embedding")
def cascade(c):
    s = c.source()
    left = rows.cascade_delete(s, {"insight": (c.source_insight(), "source"), "embedding": (c.source_embedding(), "source")}, s.where("updated < 300").select("id"))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(left["insight"], "insight").unionAll(count(left["embedding"], "embedding")).unionAll(count(left["parents"], "source"))


@query("delete_and_update_where", "SELECT id, CASE WHEN updated > 500 THEN 0 ELSE updated END AS updated FROM source WHERE NOT title LIKE 'src1 %'", "source")
def delete_update(c):
    s = rows.delete_where(c.source().select("id", "title", "updated"), F.col("title").like("src1 %"))
    return rows.update_where(s, F.col("updated") > 500, updated=F.lit(0).cast("long")).select("id", "updated")


@query("relate_once", "SELECT \"in\", out FROM reference UNION ALL (SELECT \"in\", 'notebook:src0' FROM reference EXCEPT SELECT \"in\", out FROM reference)", "reference")
def relate_once(c):
    r = c.reference()
    return rows.relate_once(r, r.select("in", F.lit("notebook:src0").alias("out")))


@query("replace_children_by_parent", "SELECT id, source FROM source_embedding WHERE NOT source IN ('source:2', 'source:4') UNION ALL SELECT 'new:' || id, source FROM source_embedding WHERE source IN ('source:2', 'source:4') AND \"order\" = 0", "source_embedding")
def replace_children(c):
    e = c.source_embedding().select("id", "source", "order")
    fresh = e.where(F.col("source").isin("source:2", "source:4") & (F.col("order") == 0)).select(F.concat(F.lit("new:"), "id").alias("id"), "source")
    return rows.replace_by_parent(e.select("id", "source"), fresh, "source")


@query("first_problem_of_rows", "SELECT id, CASE WHEN length(trim(content)) = 0 THEN 'blank' WHEN length(content) > 400 THEN 'long' WHEN note_type <> 'human' THEN 'kind' END AS problem FROM note", "note")
def validation(c):
    checks = {"blank": F.length(F.trim("content")) > 0, "long": F.length("content") <= 400, "kind": F.col("note_type") == "human"}
    return rows.valid_rows(c.note().select("id", "content", "note_type"), checks).select("id", "problem")


@query("page_of_sources", "SELECT id, updated FROM source ORDER BY updated DESC, id LIMIT 30 OFFSET 60", "source")
def page(c):
    return rows.page(c.source().select("id", "updated"), [F.desc("updated"), F.col("id")], 30, 60)


@query("notebook_sources", "SELECT s.id, s.title, s.updated FROM reference AS r JOIN source AS s ON s.id = r.\"in\" WHERE r.out = 'notebook:src3' ORDER BY s.updated DESC", "reference", "source")
def notebook_sources(c):
    return graph.incoming(c.reference(), "notebook:src3", c.source(), ("full_text",)).select("id", "title", "updated").orderBy(F.desc("updated"))


@query("notebook_notes", "SELECT n.id, n.title, n.note_type, n.updated FROM artifact AS a JOIN note AS n ON n.id = a.\"in\" WHERE a.out = 'notebook:src3'", "note", "artifact")
def notebook_notes(c):
    return graph.incoming(c.artifact(), "notebook:src3", c.note(), ("content",)).select("id", "title", "note_type", "updated")


@query("notebook_chat_sessions", "SELECT s.id, s.title, s.created FROM refers_to AS r JOIN chat_session AS s ON s.id = r.\"in\" WHERE r.out = 'notebook:src4' ORDER BY s.created DESC, s.id", "chat_session", "refers_to")
def notebook_chats(c):
    return graph.incoming(c.refers_to(), "notebook:src4", c.chat_session()).select("id", "title", "created").orderBy(F.desc("created"), "id")


_DEGREES = """
SELECT n.id, n.name, coalesce(r.k, 0) AS source_count, coalesce(a.k, 0) AS note_count FROM notebook AS n
LEFT JOIN (SELECT out, count(*) AS k FROM reference GROUP BY out) AS r ON r.out = n.id LEFT JOIN (SELECT out, count(*) AS k FROM artifact GROUP BY out) AS a ON a.out = n.id
"""


@query("notebook_degrees", _DEGREES, "notebook", "reference", "artifact")
def notebook_degrees(c):
    return graph.degrees(c.notebook().select("id", "name"), source_count=c.reference(), note_count=c.artifact())


@query("edge_lookup", "SELECT out FROM reference WHERE \"in\" = 'source:50'", "reference")
def edge_lookup(c):
    return c.reference().where(F.col("in") == "source:50").select("out")


@query("sources_linked_to_chats", "SELECT id, title FROM source WHERE id IN (SELECT out FROM refers_to)", "source", "chat_session", "refers_to")
def linked(c):
    return c.source().select("id", "title").join(c.refers_to().select(F.col("out").alias("id")), "id", "left_semi")


_LISTED = """
SELECT s.id, s.title, s.updated, coalesce(i.k, 0) AS insights_count, e.source IS NOT NULL AS embedded, CASE WHEN s.command IS NULL THEN NULL ELSE coalesce(c.status, 'unknown') END AS status
FROM source AS s LEFT JOIN (SELECT source, count(*) AS k FROM source_insight GROUP BY source) AS i ON i.source = s.id
LEFT JOIN (SELECT DISTINCT source FROM source_embedding WHERE embedding IS NOT NULL) AS e ON e.source = s.id LEFT JOIN command AS c ON c.command = s.command
"""


@query("source_list_with_counts", _LISTED, "source", "source_insight", "source_embedding", "command")
def source_list(c):
    insights = c.source_insight().groupBy(F.col("source").alias("id")).agg(F.count("*").alias("k"))
    embedded = c.source_embedding().where("embedding IS NOT NULL").select(F.col("source").alias("id")).distinct().withColumn("e", F.lit(True))
    jobs = c.command().select("command", F.col("status").alias("st"))
    s = c.source().join(insights, "id", "left").join(embedded, "id", "left").join(jobs, "command", "left")
    status = F.when(F.col("command").isNotNull(), F.coalesce("st", F.lit("unknown")))
    return s.select("id", "title", "updated", F.coalesce("k", F.lit(0)).alias("insights_count"), F.col("e").isNotNull().alias("embedded"), status.alias("status"))


@query("missing_ids", "SELECT i.source FROM (SELECT DISTINCT source FROM source_insight) AS i ANTI JOIN source AS s ON s.id = i.source", "source", "source_insight")
def missing(c):
    return c.source_insight().select("source").distinct().join(c.source().select(F.col("id").alias("source")), "source", "left_anti")


@query("sources_by_transformations", "SELECT s.id, t.name FROM source AS s CROSS JOIN (VALUES ('summary'), ('questions')) AS t(name)", "source")
def fan_out(c):
    # A stated, fixed list of transformations.
    names = F.explode(F.array(F.lit("summary"), F.lit("questions")))
    return c.source().select("id", names.alias("name"))


@query("usage_counts_with_zeros", "SELECT n.id, count(s.id) AS sessions FROM notebook AS n LEFT JOIN refers_to AS r ON r.out = n.id LEFT JOIN chat_session AS s ON s.id = r.\"in\" GROUP BY n.id", "notebook", "chat_session", "refers_to")
def usage(c):
    return graph.degrees(c.notebook().select("id"), sessions=c.refers_to())


@query("set_difference_of_links", "SELECT 'add' AS side, \"in\" FROM (SELECT DISTINCT \"in\" FROM reference WHERE out = 'notebook:src1' EXCEPT SELECT \"in\" FROM reference WHERE \"in\" LIKE '%1') UNION ALL SELECT 'remove', \"in\" FROM (SELECT DISTINCT \"in\" FROM reference WHERE \"in\" LIKE '%1' EXCEPT SELECT \"in\" FROM reference WHERE out = 'notebook:src1')", "reference")
def difference(c):
    r = c.reference()
    wanted, there = r.where("out = 'notebook:src1'").select("in").distinct(), r.where(F.col("in").like("%1")).select("in").distinct()
    side = lambda a, b, s: a.join(b, "in", "left_anti").select(F.lit(s).alias("side"), "in")
    return side(wanted, there, "add").unionAll(side(there, wanted, "remove"))


@query("prefix_and_truncation", "SELECT id, CASE WHEN length(title) > 6 THEN left(title, 6) || '...' ELSE title END AS short, left(full_text, 100) AS head, replace(id, 'source:', '') AS bare FROM source", "source")
def truncation(c):
    return c.source().select("id", t.truncated(F.col("title"), 6, "...").alias("short"), F.substring("full_text", 1, 100).alias("head"), F.regexp_replace("id", "^source:", "").alias("bare"))


@query("size_based_routing", "SELECT id, CASE WHEN floor(len(list_filter(string_split_regex(full_text, '\\s+'), lambda x: x <> '')) * 1.3) > 5000 THEN 'large_context' WHEN topics[1] = 'en' THEN 'explicit' ELSE 'default' END AS route FROM source", "source")
def routing(c):
    return c.source().select("id", F.when(t.token_estimate(F.col("full_text")) > 5000, "large_context").when(F.col("topics")[0] == "en", "explicit").otherwise("default").alias("route"))


_TWO_HOPS = """
WITH a AS (SELECT DISTINCT "in", out FROM refers_to), b AS (SELECT DISTINCT out AS x, "in" AS id FROM artifact),
o AS (SELECT s.id, list_sort(list(a.out)) AS outs FROM chat_session AS s LEFT JOIN a ON a."in" = s.id GROUP BY s.id),
c AS (SELECT id AS start, min(id) OVER (PARTITION BY outs) AS class FROM o)
SELECT c.start, c.class, NULL::VARCHAR AS id, count(b.id) AS walks FROM c LEFT JOIN a ON a."in" = c.start LEFT JOIN b ON b.x = a.out GROUP BY c.start, c.class
UNION ALL SELECT c.start, c.class, b.id, count(*) FROM c JOIN a ON a."in" = c.start JOIN b ON b.x = a.out WHERE c.start = c.class GROUP BY c.start, c.class, b.id
"""


@query("two_hop_neighbours", _TWO_HOPS, "chat_session", "note", "refers_to", "artifact")
def two_hops(c):
    """Every note that each chat session reaches through what it refers to: sessions with their class, and each class's notes."""
    edges = c.refers_to().unionByName(c.artifact().select(F.col("out").alias("in"), F.col("in").alias("out")))
    return graph.two_hops(edges, c.chat_session().select("id"))


@query("co_linked_sources", "SELECT r.\"in\" AS id, count(*) AS shared FROM (SELECT DISTINCT \"in\", out FROM reference) AS r WHERE r.out IN (SELECT out FROM reference WHERE \"in\" = 'source:3') AND r.\"in\" <> 'source:3' GROUP BY 1 ORDER BY shared DESC, id LIMIT 20", "reference")
def co_linked(c):
    return graph.co_linked(c.reference(), "source:3", 20)
