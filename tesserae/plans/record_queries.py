"""Queries of record changes, predicates, small aggregates and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.operators import graph, rows
from tesserae.operators.keyed import KeyedTable
from tesserae.operators.lineage import shared_folder
from tesserae.plans.registry import query

#: The table that an id's prefix names, and the kind of record in it.
KINDS = {"source": "source", "note": "note", "source_insight": "insight", "chat_session": "session"}


@query("kind_by_id_prefix", "SELECT id, CASE split_part(id, ':', 1) WHEN 'source' THEN 'source' WHEN 'note' THEN 'note' WHEN 'source_insight' THEN 'insight' WHEN 'chat_session' THEN 'session' END AS kind FROM (SELECT id FROM source UNION ALL SELECT id FROM note UNION ALL SELECT id FROM source_insight UNION ALL SELECT id FROM notebook)", "source", "note", "source_insight", "notebook")
def kind_by_prefix(c):
    ids = c.source().select("id").unionAll(c.note().select("id")).unionAll(c.source_insight().select("id")).unionAll(c.notebook().select("id"))
    return ids.select("id", F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.substring_index("id", ":", 1)].alias("kind"))


_SETTINGS = "SELECT 'settings' AS id, count(*) AS documents, max(doc_id) AS newest, 'auto' AS engine FROM documents"


@query("singleton_upsert_and_patch", f"SELECT id, documents, newest, 'simple' AS engine, true AS ready FROM ({_SETTINGS}) UNION ALL SELECT 'prompts', NULL, NULL, 'plain', NULL")
def singleton(c):
    one = c.raw("documents").agg(F.count("*").alias("documents"), F.max("doc_id").alias("newest")).select(F.lit("settings").alias("id"), "documents", "newest", F.lit("auto").alias("engine"))
    patched = rows.patched(one, engine=F.lit("simple"), ready=F.lit(True))
    literal = c.spark.createDataFrame([("prompts", "plain")], "id string, engine string")
    return rows.upsert_merge(patched, literal)


@query("save_with_stamps", "SELECT n.id, coalesce(CASE WHEN n.updated < 9 THEN upper(n.name) END, n.name) AS name, 5::BIGINT AS created, CASE WHEN n.updated < 9 THEN 77 ELSE n.updated END AS updated FROM notebook AS n UNION ALL SELECT id || '_n', name, 77, 77 FROM notebook WHERE updated > 12", "notebook")
def save(c):
    n = c.notebook().select("id", "name", F.lit(5).cast("long").alias("created"), "updated")
    known = n.where("updated < 9").select("id", F.upper("name").alias("name"))
    new = n.where("updated > 12").select(F.concat("id", F.lit("_n")).alias("id"), "name")
    return rows.saved(n, known.unionAll(new), F.lit(77).cast("long"))


_CHILDREN = """
SELECT 'insight' AS what, id, source AS linked FROM source_insight UNION ALL SELECT 'insight', 'source_insight:new_' || id, id FROM source
UNION ALL SELECT 'seed', id, NULL FROM (SELECT id FROM notebook UNION SELECT 'notebook:start') UNION ALL SELECT 'artifact', "in", out FROM artifact UNION ALL SELECT 'artifact', id, 'notebook:start' FROM note
"""


@query("child_rows_seeds_and_typed_edges", _CHILDREN, "source", "source_insight", "notebook", "note", "artifact")
def children(c):
    """The rows after an insight is added to each source, two seeds of which one is known, and an edge of each note."""
    fresh = c.source().select(F.concat(F.lit("source_insight:new_"), "id").alias("id"), F.col("id").alias("source"))
    insights = rows.insert(c.source_insight().select("id", "source"), fresh)
    seeds = rows.seed_if_absent(c.notebook().select("id"), c.spark.createDataFrame([("notebook:start",), ("notebook:src0",)], "id string"))
    edges = rows.relate(c.artifact(), c.note().select(F.col("id").alias("in"), F.lit("notebook:start").alias("out")))
    named = lambda df, what, key, linked: df.select(F.lit(what).alias("what"), F.col(key).alias("id"), linked.alias("linked"))
    return named(insights, "insight", "id", F.col("source")).unionAll(named(seeds, "seed", "id", F.lit(None).cast("string"))).unionAll(named(edges, "artifact", "in", F.col("out")))


@query("session_belongs_to_source", "SELECT \"in\", out FROM refers_to WHERE \"in\" = 'chat_session:7' AND out = 'source:7'", "chat_session", "refers_to")
def both_ends(c):
    return graph.linked_both(c.refers_to(), F.lit("chat_session:7"), F.lit("source:7"))


@query("unlink_source", "SELECT \"in\", out FROM reference WHERE NOT (\"in\" = 'source:50' AND out IN (SELECT out FROM reference WHERE \"in\" = 'source:50'))", "reference")
def unlinked(c):
    target = c.reference().where(F.col("in") == "source:50").select("out").first()
    return graph.unlink(c.reference(), "source:50", target["out"] if target else "")


@query("sessions_of_sources", "SELECT r.out AS source, s.id, s.title, s.created FROM refers_to AS r JOIN chat_session AS s ON s.id = r.\"in\" WHERE r.out LIKE 'source:%' ORDER BY s.created DESC, s.id", "chat_session", "refers_to")
def sessions(c):
    s = c.chat_session().select("id", "title", "created")
    return c.refers_to().where(F.col("out").startswith("source:")).select(F.col("out").alias("source"), F.col("in").alias("id")).join(s, "id").orderBy(F.desc("created"), "id")


@query("blank_query_is_no_filter", "SELECT id, 'blank' AS asked FROM notebook UNION ALL SELECT id, 'src1' FROM notebook WHERE contains(lower(name), 'src1')", "notebook")
def blank(c):
    n = c.notebook()
    matching = lambda asked: n.where(F.lower("name").contains(asked.strip().lower())) if asked.strip() else n
    return matching("  ").select("id", F.lit("blank").alias("asked")).unionAll(matching(" SRC1 ").select("id", F.lit("src1").alias("asked")))


@query("episodes_with_work", "SELECT id, command, audio FROM (SELECT id, command, CASE WHEN updated % 5 = 0 THEN 'file:///tmp/' || replace(id, ':', '%3A') || '.mp3' END AS audio FROM source) WHERE command IS NOT NULL OR audio IS NOT NULL", "source")
def episodes(c):
    audio = F.when(F.col("updated") % 5 == 0, F.concat(F.lit("file:///tmp/"), F.regexp_replace("id", ":", "%3A"), F.lit(".mp3")))
    return c.source().select("id", "command", audio.alias("audio")).where(~(F.col("command").isNull() & F.col("audio").isNull()))


@query("audio_paths", "SELECT id, CASE WHEN updated % 2 = 0 THEN '/tmp/' || id || ' 1+1.mp3' ELSE '/kept/a%20b' END AS path FROM source", "source")
def audio(c):
    url = F.when(F.col("updated") % 2 == 0, F.concat(F.lit("file:///tmp/"), F.regexp_replace("id", ":", "%3A"), F.lit("%201+1.mp3"))).otherwise("/kept/a%20b")
    return c.source().select("id", t.file_path(url).alias("path"))


@query("sort_by_allowed_column", "SELECT id, updated FROM source ORDER BY updated DESC, id", "source")
def sort_by(c):
    return c.source().select("id", "updated").orderBy(*rows.sort_key("updated desc", ("created", "updated")))


@query("update_of_given_fields", "SELECT id, CASE WHEN updated % 3 = 0 THEN 'renamed' ELSE name END AS name, archived, updated FROM notebook", "notebook")
def given_fields(c):
    return rows.non_null_update(c.notebook(), name=F.when(F.col("updated") % 3 == 0, "renamed"), archived=F.lit(None).cast("boolean"))


@query("real_messages_only", "SELECT id FROM (SELECT CASE WHEN turn % 2 = 1 THEN 'temp-' || id ELSE id END AS id FROM note) WHERE NOT id LIKE 'temp-%'", "note")
def real_messages(c):
    ids = c.note().select(F.when(F.col("turn") % 2 == 1, F.concat(F.lit("temp-"), "id")).otherwise(F.col("id")).alias("id"))
    return ids.where(~F.col("id").startswith("temp-"))


#: Transformations, and whether each is applied by default.
TRANSFORMATIONS = [("summary", True), ("questions", False), ("outline", True)]


@query("default_transformations", "SELECT s.id, t.name FROM source AS s CROSS JOIN (VALUES ('summary', true), ('questions', false), ('outline', true)) AS t(name, apply_default) WHERE t.apply_default", "source")
def defaults(c):
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(d).alias("apply_default")) for n, d in TRANSFORMATIONS))
    return c.source().select("id", F.explode(names).alias("e")).where("e.apply_default").select("id", "e.name")


_RESULT = "SELECT event_id, to_json({'status': status, 'execution_metadata': {'started_at': event_id, 'completed_at': event_id + 5}, 'error_message': CASE WHEN status = 'failed' THEN 'no ' || command END}) AS result FROM job_event"


@query("job_results_from_json", "SELECT event_id, status, event_id::BIGINT AS started_at, (event_id + 5)::BIGINT AS completed_at, CASE WHEN status = 'failed' THEN 'no ' || command END AS error_message FROM job_event", "job_event")
def results(c):
    times = F.struct(F.col("event_id").alias("started_at"), (F.col("event_id") + 5).alias("completed_at"))
    said = F.to_json(F.struct("status", times.alias("execution_metadata"), F.when(F.col("status") == "failed", F.concat(F.lit("no "), "command")).alias("error_message")))
    read = F.from_json("result", "status string, execution_metadata struct<started_at: bigint, completed_at: bigint>, error_message string")
    return c.job_event().select("event_id", said.alias("result")).select("event_id", read.alias("r")).select("event_id", "r.status", "r.execution_metadata.started_at", "r.execution_metadata.completed_at", "r.error_message")


@query("profile_by_name_chain", "SELECT e.id, e.name, s.archived AS speaker_archived FROM notebook AS e JOIN notebook AS s ON s.name = 'src' || ((regexp_extract(e.name, '(\\d+)$', 1)::BIGINT + 1) % 20)", "notebook")
def profiles(c):
    n = c.notebook()
    speaker = n.select(F.col("name").alias("speaker"), F.col("archived").alias("speaker_archived"))
    wanted = F.concat(F.lit("src"), ((F.regexp_extract("name", r"(\d+)$", 1).cast("long") + 1) % 20).cast("string"))
    return n.withColumn("speaker", wanted).join(speaker, "speaker").select("id", "name", "speaker_archived")


_STATS = "SELECT user_id, list(value) FILTER (WHERE status = 'completed') AS v FROM job_event GROUP BY user_id"


@query("statistics_or_error", f"SELECT user_id, coalesce(len(v), 0)::INT AS n, round(list_sum(v), 4) AS total, round(list_avg(v), 6) AS mean, list_min(v) AS low, list_max(v) AS high, CASE WHEN v IS NULL THEN 'no numbers' END AS error FROM ({_STATS})", "job_event")
def numbers(c):
    """Of each user's completed events; a user without any has an error."""
    value = F.when(F.col("status") == "completed", F.col("value"))
    s = c.job_event().groupBy("user_id").agg(F.count(value).cast("int").alias("n"), F.sum(value).alias("s"), F.avg(value).alias("a"), F.min(value).alias("low"), F.max(value).alias("high"))
    return s.select("user_id", "n", F.round("s", 4).alias("total"), F.round("a", 6).alias("mean"), "low", "high", F.when(F.col("n") == 0, "no numbers").alias("error"))


@query("has_spatial_data", "SELECT source, bool_or(box IS NOT NULL AND element_type <> 'table') AS has_spatial_data, count(*) AS chunks FROM elements GROUP BY source", "elements")
def spatial(c):
    return c.elements().groupBy("source").agg(F.bool_or(F.col("box").isNotNull() & (F.col("element_type") != "table")).alias("has_spatial_data"), F.count("*").alias("chunks"))


@query("settled_counts", "SELECT command, count(*) FILTER (WHERE status = 'completed') AS fulfilled, count(*) FILTER (WHERE status = 'failed') AS rejected FROM job_event GROUP BY command", "job_event")
def settled(c):
    return c.job_event().groupBy("command").agg(F.count_if(F.col("status") == "completed").alias("fulfilled"), F.count_if(F.col("status") == "failed").alias("rejected"))


_MODES = "SELECT r.out, s.updated % 3 AS m, s.full_text FROM reference AS r JOIN source AS s ON s.id = r.\"in\""


@query("selected_counts_and_sizes", f"SELECT out AS notebook, count(*) FILTER (WHERE m <> 0) AS selected, coalesce(sum(length(full_text)) FILTER (WHERE m = 2), 0)::BIGINT AS chars, coalesce(sum(floor(len(list_filter(string_split_regex(full_text, '\\s+'), lambda x: x <> '')) * 1.3)) FILTER (WHERE m = 2), 0)::BIGINT AS tokens FROM ({_MODES}) GROUP BY out", "reference", "source")
def selected(c):
    s = c.source().select(F.col("id").alias("in"), (F.col("updated") % 3).alias("m"), F.length("full_text").alias("chars"), t.token_estimate(F.col("full_text")).alias("tokens"))
    full = lambda x: F.coalesce(F.sum(F.when(F.col("m") == 2, F.col(x))), F.lit(0))
    return c.reference().join(s, "in").groupBy(F.col("out").alias("notebook")).agg(F.count_if(F.col("m") != 0).alias("selected"), full("chars").alias("chars"), full("tokens").alias("tokens"))


@query("latest_version_or_zero", "SELECT coalesce(max(regexp_extract(name, '(\\d+)$', 1)::BIGINT), 0) AS version, 'all' AS of FROM notebook UNION ALL SELECT coalesce(max(regexp_extract(name, '(\\d+)$', 1)::BIGINT), 0), 'none' FROM notebook WHERE name = ''", "notebook")
def latest_version(c):
    most = lambda df, of: df.agg(F.coalesce(F.max(F.regexp_extract("name", r"(\d+)$", 1).cast("long")), F.lit(0)).alias("version")).select("version", F.lit(of).alias("of"))
    return most(c.notebook(), "all").unionAll(most(c.notebook().where("name = ''"), "none"))


@query("page_with_more", "SELECT id, updated, true AS has_more FROM (SELECT id, updated FROM source ORDER BY updated DESC, id LIMIT 30 OFFSET 30)", "source")
def infinite(c):
    shown = c.source().select("id", "updated").orderBy(F.desc("updated"), "id").offset(30).limit(30)
    full = shown.agg((F.count("*") == 30).alias("has_more"))
    return shown.join(F.broadcast(full))


@query("dates_of_events", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, strftime(ts, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch(strptime(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ'))::BIGINT AS seconds FROM events")
def dates(c):
    e, iso = c.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return e.select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format(F.col("ts") + F.expr("INTERVAL 1 DAY"), iso).alias("iso"), F.unix_timestamp(F.to_timestamp(F.date_format("ts", iso), iso)).alias("seconds"))


@query("arrays_and_maps", "SELECT id, list_sort(list_distinct([name, 'x', name, 'a'])) AS one, list_sort(list_distinct(list_concat([name], ['a', 'b']))) AS both, flatten([[name], ['z', 'z']]) AS flat, [name, 'q'][1] AS first, map_entries(MAP {'name': name, 'id': id})[1].key AS k FROM notebook", "notebook")
def arrays(c):
    name = F.col("name")
    return c.notebook().select(
        "id", F.array_sort(F.array_distinct(F.array(name, F.lit("x"), name, F.lit("a")))).alias("one"), F.array_sort(F.array_union(F.array(name), F.array(F.lit("a"), F.lit("b")))).alias("both"),
        F.flatten(F.array(F.array(name), F.array(F.lit("z"), F.lit("z")))).alias("flat"), F.element_at(F.array(name, F.lit("q")), 1).alias("first"), F.map_entries(F.create_map(F.lit("name"), name, F.lit("id"), F.col("id")))[0]["key"].alias("k"),
    )


@query("ids_as_text", "SELECT to_json({'id': id, 'topics': topics, 'command': command})::VARCHAR AS dumped, id FROM source", "source")
def dumped(c):
    return c.source().select(F.to_json(F.struct("id", "topics", "command"), {"ignoreNullFields": "false"}).alias("dumped"), "id")


@query("newest_insight_of_source", "SELECT source, max_by(id, (updated, id)) AS id FROM (SELECT i.source, i.id, i.doc_id * 7 % 50 AS updated FROM source_insight AS i) GROUP BY source", "source_insight")
def newest(c):
    i = c.source_insight().select("source", "id", (F.col("doc_id") * 7 % 50).alias("updated"))
    return i.groupBy("source").agg(F.max_by("id", F.struct("updated", "id")).alias("id"))


@query("numbered_lines", "SELECT source, idx, place FROM (SELECT source, idx, text, rank() OVER (PARTITION BY source, page ORDER BY idx)::INT AS place FROM elements) WHERE trim(text) <> ''", "elements")
def numbered(c):
    place = F.rank().over(Window.partitionBy("source", "page").orderBy("idx"))
    # Numbered before blank lines are left out: the numbers have gaps.
    return c.elements().withColumn("place", place).where(F.trim("text") != "").select("source", "idx", "place")


@query("three_heading_kinds", "SELECT source, idx, last_value(CASE WHEN kind IN ('section_header', 'title', 'heading') THEN text END IGNORE NULLS) OVER (PARTITION BY source ORDER BY idx ROWS UNBOUNDED PRECEDING) AS chapter FROM (SELECT source, idx, text, CASE WHEN idx % 12 = 4 THEN 'title' WHEN idx % 12 = 9 THEN 'heading' ELSE element_type END AS kind FROM elements)", "elements")
def headings(c):
    kind = F.when(F.col("idx") % 12 == 4, "title").when(F.col("idx") % 12 == 9, "heading").otherwise(F.col("element_type"))
    before = Window.partitionBy("source").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    chapter = F.last(F.when(kind.isin("section_header", "title", "heading"), F.col("text")), ignorenulls=True).over(before)
    return c.elements().select("source", "idx", chapter.alias("chapter"))


_WRITES = """
SELECT id, CASE WHEN updated % 3 = 0 THEN upper(title) ELSE title END AS title, CASE WHEN updated % 5 = 0 THEN updated + 1000 ELSE updated END AS updated FROM source WHERE updated % 7 <> 0
UNION ALL SELECT id || '_copy', title || ' - Copy', NULL FROM source WHERE updated % 11 = 0
"""


@query("keyed_writes_with_a_repeated_batch", _WRITES, "source")
def keyed_writes(c):
    """Inserts, merges, a change that depends on old values and is sent twice, and deletes, as writes to a table by key."""
    s = c.source().select("id", "title", "updated")
    table = KeyedTable(c.spark, f"{shared_folder(c.spark)}/keyed-{uuid.uuid4().hex}", s.schema, buckets=8)
    table.insert("load", s)
    table.upsert("titles", s.where("updated % 3 = 0").select("id", F.upper("title").alias("title")))
    for _ in range(2):
        table.change("later", s.where("updated % 5 = 0").select("id"), updated=F.col("updated") + 1000)
    table.delete("gone", s.where("updated % 7 = 0").select("id"))
    table.insert("copies", s.where("updated % 11 = 0").select(F.concat("id", F.lit("_copy")).alias("id"), F.concat("title", F.lit(" - Copy")).alias("title"), F.lit(None).cast("long").alias("updated")))
    return table.read()
