"""The logical tables (notebooks, sources, notes, edges, vectors, jobs) as views over the given Parquet tables.

Each function is a lazy plan over one or two scans, so what a query does not
use is pruned from the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def version(self, *names: str) -> tuple:
        """Sizes and times of the given tables' files, by which a kept index is known to be of them."""
        conf, out = self.spark._jsc.hadoopConfiguration(), []
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
            fs = path.getFileSystem(conf)
            out.append((name, fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime()))
        return tuple(out)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def source(self) -> DataFrame:
        d = self.raw("documents")
        return d.select(
            record_id("source", F.col("doc_id")).alias("id"),
            F.concat("source", F.lit(" #"), F.col("doc_id").cast("string")).alias("title"),
            F.array("lang").alias("topics"),
            F.col("text").alias("full_text"),
            F.when(F.col("doc_id") % 3 != 0, record_id("command", F.col("doc_id") % 50)).alias("command"),
            (F.col("doc_id") * 37 % 1000).alias("updated"),
            (F.col("doc_id") * 11 % 700).alias("created"),
        )

    def notebook(self) -> DataFrame:
        suffix = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
        return self.raw("documents").select(F.col("source").alias("name")).distinct().select(
            record_id("notebook", F.col("name")).alias("id"), "name", (suffix % 2 == 0).alias("archived"), (suffix * 13 % 17).alias("updated")
        )

    def reference(self) -> DataFrame:
        """source -> notebook; every fiftieth edge is there twice."""
        d = self.raw("documents").select("doc_id", record_id("source", F.col("doc_id")).alias("in"), record_id("notebook", F.col("source")).alias("out"))
        return d.select("in", "out").unionAll(d.where("doc_id % 50 = 0").select("in", "out"))

    def source_embedding(self) -> DataFrame:
        """Chunks: of every four vectors two belong to a source, one to an insight and one to a note."""
        e = self.raw("embeddings").where("vec_id % 4 < 2")
        return e.select(
            record_id("source_embedding", F.col("vec_id")).alias("id"),
            record_id("source", F.floor(F.col("vec_id") / 4)).alias("source"),
            (F.col("vec_id") % 4).cast("long").alias("order"),
            F.concat(F.lit("chunk "), F.col("vec_id").cast("string"), F.lit(" label "), F.col("label").cast("string")).alias("content"),
            "embedding",
        )

    def source_insight(self) -> DataFrame:
        """Two insights a labelled document; every tenth is a dangling link."""
        one = self.raw("labels").select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("k"), F.col("quality").alias("v")), F.struct(F.lit("toxic").alias("k"), F.col("toxic").alias("v")))).alias("e"))
        return one.select(
            F.concat(F.lit("source_insight:"), F.col("doc_id").cast("string"), F.lit("_"), F.col("e.k")).alias("id"),
            F.when(F.col("doc_id") % 10 == 9, F.concat(F.lit("source:gone"), F.col("doc_id").cast("string"))).otherwise(record_id("source", F.col("doc_id"))).alias("source"),
            F.col("e.k").alias("insight_type"),
            F.concat(F.lit("the "), F.col("e.k"), F.lit(" label is "), F.col("e.v").cast("string")).alias("content"),
            "doc_id",
        )

    def insight_vectors(self) -> DataFrame:
        """A quarter of the vectors, each of one insight; a source without a label has an insight that says so."""
        v = self.raw("embeddings").where("vec_id % 4 = 2").select(F.floor(F.col("vec_id") / 4).alias("doc_id"), "embedding")
        said = self.source_insight().where("insight_type = 'quality'").select("doc_id", F.col("content").alias("said"))
        return v.join(said, "doc_id", "left").select(
            F.concat(F.lit("source_insight:"), F.col("doc_id").cast("string"), F.lit("_quality")).alias("id"), record_id("source", F.col("doc_id")).alias("source"), F.lit("quality").alias("insight_type"), F.coalesce("said", F.lit("no label")).alias("content"), "embedding"
        )

    def note(self) -> DataFrame:
        c = self.raw("conversations")
        return c.select(
            F.concat(F.lit("note:"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
            F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"),
            F.col("text").alias("content"),
            F.when(F.col("role") == "user", "human").otherwise("ai").alias("note_type"),
            (F.col("conv_id") * 7 % 500 + F.col("turn")).alias("updated"),
            "conv_id",
            "turn",
        )

    def note_vectors(self) -> DataFrame:
        """A quarter of the vectors, each of a conversation's second turn, or of an empty note where there is none."""
        v = self.raw("embeddings").where("vec_id % 4 = 3").select(F.floor(F.col("vec_id") / 4).alias("conv_id"), "embedding")
        said = self.note().where("turn = 1").select("conv_id", "content")
        return v.join(said, "conv_id", "left").select(
            F.concat(F.lit("note:"), F.col("conv_id").cast("string"), F.lit("_1")).alias("id"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"), F.coalesce("content", F.lit("")).alias("content"), "embedding"
        )

    def artifact(self) -> DataFrame:
        """note -> notebook."""
        return self.note().select(F.col("id").alias("in"), F.concat(F.lit("notebook:src"), (F.col("conv_id") % 20).cast("string")).alias("out"))

    def chat_session(self) -> DataFrame:
        return self.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("messages")).select(
            record_id("chat_session", F.col("conv_id")).alias("id"), F.concat(F.lit("Chat "), F.col("conv_id").cast("string")).alias("title"), "messages", (F.col("conv_id") * 5 % 97).alias("created"), "conv_id"
        )

    def refers_to(self) -> DataFrame:
        """chat session -> notebook (even) or source (odd)."""
        s = self.chat_session()
        return s.select(F.col("id").alias("in"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("notebook:src"), (F.col("conv_id") % 20).cast("string"))).otherwise(record_id("source", F.col("conv_id"))).alias("out"))

    def links(self) -> DataFrame:
        """All edges together: sources and notes to notebooks, chat sessions to what they refer to, sources to their topic."""
        topics = self.source().select(F.col("id").alias("in"), F.concat(F.lit("topic:"), F.col("topics")[0]).alias("out")).where("out IS NOT NULL")
        return self.reference().unionAll(self.artifact()).unionAll(self.refers_to()).unionAll(topics)

    def job_event(self) -> DataFrame:
        """Status changes of jobs: one job for each user."""
        status = F.create_map(*(F.lit(x) for pair in STATUS_OF_EVENT.items() for x in pair))[F.col("event_type")]
        return self.raw("events").select("event_id", "ts", record_id("command", F.col("user_id") % 50).alias("command"), "user_id", status.alias("status"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))

    def command(self) -> DataFrame:
        """Each job's latest status."""
        return self.job_event().groupBy("command").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("event_id").alias("last_event"))

    def elements(self) -> DataFrame:
        """Document elements in reading order: lines, with a kind, a page and an integer box each."""
        lines = self.raw("documents").select(record_id("source", F.col("doc_id")).alias("source"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))
        kind = F.element_at(F.array(*map(F.lit, ("section_header", "paragraph", "text", "paragraph", "table", "picture"))), (F.col("idx") % 6 + 1).cast("int"))
        return lines.select(
            "source", F.col("idx").cast("long").alias("idx"), kind.alias("element_type"), "text", (F.floor(F.col("idx") / 4) + 1).cast("long").alias("page"),
            F.struct((F.col("idx") * 10 % 600).cast("double").alias("l"), (F.col("idx") * 10 % 600 + 100).cast("double").alias("r"), (F.col("idx") * 20 % 850).cast("double").alias("t"), (F.col("idx") * 20 % 850 + 15).cast("double").alias("b"), (F.col("idx") % 2 == 0).alias("bottom_left")).alias("box"),
        )


    def parsed(self) -> DataFrame:
        """(id, parsed): each document as JSON of nested items, made of its lines; odd pages have a size, every seventh item no
        place, every fifth two, every tenth line is a table."""
        box = lambda i: F.struct((i * 10 % 600).cast("double").alias("l"), (i * 10 % 600 + 100).cast("double").alias("r"), (i * 20 % 850).cast("double").alias("t"), (i * 20 % 850 + 15).cast("double").alias("b"), F.when(i % 2 == 0, "CoordOrigin.BOTTOMLEFT").when(i % 3 == 0, "TOPLEFT").alias("coord_origin"))
        place = lambda i, more: F.struct((F.floor(i / 4) + 1 + more).cast("int").alias("page_no"), box(i).alias("bbox"))
        prov = lambda i: F.when(i % 7 != 3, F.when(i % 5 == 0, F.array(place(i, 0), place(i, 1))).otherwise(F.array(place(i, 0))))
        label = lambda i: F.element_at(F.array(*map(F.lit, ("section_header", "paragraph", "text", "title", "paragraph", "caption"))), (i % 6 + 1).cast("int"))

        def item(line: Column, i: Column) -> Column:
            kind = F.when(i % 10 == 9, "table").when(i % 10 == 7, "picture").when(i % 10 == 6, "formula").otherwise("text")
            return F.struct(
                kind.alias("kind"), F.when(kind == "text", label(i)).alias("label"), F.when(kind.isin("text", "formula"), line).alias("text"), F.when((kind == "picture") & (i % 4 == 3), line).alias("caption"),
                F.when(kind == "table", F.array(F.array(F.lit("line"), F.lit("text")), F.array(i.cast("string"), line))).alias("rows"), prov(i).alias("prov"),
            )

        lines = F.split(F.coalesce("text", F.lit("")), "\n")
        pages = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(99), F.lit(2)), lambda p: p.cast("string")), F.transform(F.sequence(F.lit(1), F.lit(99), F.lit(2)), lambda p: F.struct((p + 600).cast("double").alias("width"), F.lit(800.0).alias("height"))))
        return self.raw("documents").select(record_id("source", F.col("doc_id")).alias("id"), F.to_json(F.struct(pages.alias("pages"), F.transform(lines, item).alias("items"))).alias("parsed"))


#: The job status that an event stands for.
STATUS_OF_EVENT = {"error": "failed", "purchase": "completed", "click": "running", "view": "queued", "signup": "new"}


def record_id(table: str, key: Column) -> Column:
    return F.concat(F.lit(f"{table}:"), key.cast("string"))


#: The same tables for DuckDB, as common table expressions over the views of the given tables.
CATALOG_SQL = {
    "source": "SELECT 'source:' || doc_id AS id, source || ' #' || doc_id AS title, [lang] AS topics, text AS full_text, CASE WHEN doc_id % 3 <> 0 THEN 'command:' || (doc_id % 50) END AS command, doc_id * 37 % 1000 AS updated, doc_id * 11 % 700 AS created FROM documents",
    "notebook": "SELECT 'notebook:' || name AS id, name, regexp_extract(name, '(\\d+)$', 1)::BIGINT % 2 = 0 AS archived, regexp_extract(name, '(\\d+)$', 1)::BIGINT * 13 % 17 AS updated FROM (SELECT DISTINCT source AS name FROM documents)",
    "reference": "SELECT 'source:' || doc_id AS \"in\", 'notebook:' || source AS out FROM documents UNION ALL SELECT 'source:' || doc_id, 'notebook:' || source FROM documents WHERE doc_id % 50 = 0",
    "source_embedding": "SELECT 'source_embedding:' || vec_id AS id, 'source:' || (vec_id // 4) AS source, vec_id % 4 AS \"order\", 'chunk ' || vec_id || ' label ' || label AS content, embedding FROM embeddings WHERE vec_id % 4 < 2",
    "source_insight": "SELECT 'source_insight:' || doc_id || '_' || k AS id, CASE WHEN doc_id % 10 = 9 THEN 'source:gone' || doc_id ELSE 'source:' || doc_id END AS source, k AS insight_type, 'the ' || k || ' label is ' || v AS content, doc_id FROM (SELECT doc_id, 'quality' AS k, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)",
    "insight_vectors": "SELECT 'source_insight:' || (e.vec_id // 4) || '_quality' AS id, 'source:' || (e.vec_id // 4) AS source, 'quality' AS insight_type, coalesce(i.content, 'no label') AS content, e.embedding FROM embeddings AS e LEFT JOIN source_insight AS i ON i.doc_id = e.vec_id // 4 AND i.insight_type = 'quality' WHERE e.vec_id % 4 = 2",
    "note": "SELECT 'note:' || conv_id || '_' || turn AS id, 'conversation ' || conv_id AS title, text AS content, CASE WHEN role = 'user' THEN 'human' ELSE 'ai' END AS note_type, conv_id * 7 % 500 + turn AS updated, conv_id, turn FROM conversations",
    "note_vectors": "SELECT 'note:' || (e.vec_id // 4) || '_1' AS id, 'conversation ' || (e.vec_id // 4) AS title, coalesce(n.content, '') AS content, e.embedding FROM embeddings AS e LEFT JOIN note AS n ON n.conv_id = e.vec_id // 4 AND n.turn = 1 WHERE e.vec_id % 4 = 3",
    "artifact": "SELECT id AS \"in\", 'notebook:src' || (conv_id % 20) AS out FROM note",
    "chat_session": "SELECT 'chat_session:' || conv_id AS id, 'Chat ' || conv_id AS title, count(*) AS messages, conv_id * 5 % 97 AS created, conv_id FROM conversations GROUP BY conv_id",
    "refers_to": "SELECT id AS \"in\", CASE WHEN conv_id % 2 = 0 THEN 'notebook:src' || (conv_id % 20) ELSE 'source:' || conv_id END AS out FROM chat_session",
    "links": "SELECT * FROM reference UNION ALL SELECT * FROM artifact UNION ALL SELECT * FROM refers_to UNION ALL SELECT id, 'topic:' || topics[1] FROM source WHERE topics[1] IS NOT NULL",
    "job_event": "SELECT event_id, ts, 'command:' || (user_id % 50) AS command, user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'new' END AS status, value, (props->>'$.k')::BIGINT AS k FROM events",
    "command": "SELECT command, max_by(status, (ts, event_id)) AS status, max(event_id) AS last_event FROM job_event GROUP BY command",
    "elements": "SELECT source, idx, ['section_header', 'paragraph', 'text', 'paragraph', 'table', 'picture'][idx % 6 + 1] AS element_type, text, idx // 4 + 1 AS page, {'l': (idx * 10 % 600)::DOUBLE, 'r': (idx * 10 % 600 + 100)::DOUBLE, 't': (idx * 20 % 850)::DOUBLE, 'b': (idx * 20 % 850 + 15)::DOUBLE, 'bottom_left': idx % 2 = 0} AS box FROM (SELECT 'source:' || doc_id AS source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)",
}
_NEEDS = {"insight_vectors": ["source_insight"], "note_vectors": ["note"], "artifact": ["note"], "refers_to": ["chat_session"], "links": ["source", "reference", "note", "artifact", "chat_session", "refers_to"], "command": ["job_event"]}


def with_tables(sql: str, *tables: str) -> str:
    """The SQL with the common table expressions that it names, and those that they need."""
    wanted: list[str] = []
    for t in tables:
        wanted += [x for x in [*_NEEDS.get(t, []), t] if x not in wanted]
    head = ", ".join(f"{t} AS ({CATALOG_SQL[t]})" for t in wanted)
    start = next((x for x in ("WITH RECURSIVE ", "WITH ") if sql.lstrip().upper().startswith(x)), None)
    return f"{start}{head}, {sql.lstrip()[len(start):]}" if start else f"WITH {head} {sql}"
