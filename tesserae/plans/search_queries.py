"""Queries of full-text and vector search, and of graph ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.operators import graph, search
from tesserae.operators.postings import TextIndex
from tesserae.plans.registry import query

_TOKENS = r"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '([\p{{Ll}}])([\p{{Lu}}])', '\1 \2', 'g'), '([\p{{L}}])([\p{{N}}])', '\1 \2', 'g'), '([\p{{N}}])([\p{{L}}])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _bm25_sql(rows: str, column: str, terms: list[str]) -> str:
    """SQL for bm25(): rows is a FROM item with id, parent_id and title."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(terms)))
    hit = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"(WITH k AS (SELECT id, parent_id, title, len(t) AS dl, {tf} FROM (SELECT id, parent_id, title, {_TOKENS.format(c=column)} AS t FROM {rows})), s AS (SELECT count(*) AS n, avg(dl) AS av, {df} FROM k) SELECT id, parent_id, title, {score} AS score FROM k, s WHERE {hit})"


def _text_sql(legs: list[tuple[str, str]], terms: list[str], n: int | None) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {_bm25_sql(rows, column, terms)}" for rows, column in legs)
    return f"SELECT id, parent_id, title, round(max(score), 6) AS relevance FROM ({union}) WHERE id IS NOT NULL GROUP BY id, parent_id, title ORDER BY max(score) DESC, id{'' if n is None else f' LIMIT {n}'}"


_SOURCE = "(SELECT id, id AS parent_id, title, full_text FROM source)"
_CHUNK = "(SELECT s.id, s.id AS parent_id, s.title, e.content FROM source_embedding AS e LEFT JOIN source AS s ON s.id = e.source)"
_INSIGHT = "(SELECT i.id, i.id AS parent_id, i.insight_type || ' - ' || coalesce(s.title, '') AS title, i.content FROM source_insight AS i LEFT JOIN source AS s ON s.id = i.source)"
_NOTE = "(SELECT id, id AS parent_id, title, content FROM note)"
_LEGS = [(_SOURCE, "title"), (_CHUNK, "content"), (_SOURCE, "full_text"), (_INSIGHT, "content"), (_NOTE, "title"), (_NOTE, "content")]


def _legs(c):
    """The six indexed texts: legs named note are searched for notes, the others for sources."""
    s = c.source().select("id", F.col("id").alias("parent_id"), "title", "full_text")
    titles = c.source().select(F.col("id").alias("source"), "title")
    chunk = c.source_embedding().select("source", "content").join(titles, "source", "left").select(F.when(F.col("title").isNotNull(), F.col("source")).alias("id"), "title", "content").withColumn("parent_id", F.col("id"))
    insight = c.source_insight().join(titles, "source", "left").select("id", F.col("id").alias("parent_id"), F.concat("insight_type", F.lit(" - "), F.coalesce("title", F.lit(""))).alias("title"), "content")
    note = c.note().select("id", F.col("id").alias("parent_id"), "title", "content")
    return [("source_title", s, "title"), ("source_chunk", chunk, "content"), ("source_text", s, "full_text"), ("source_insight", insight, "content"), ("note_title", note, "title"), ("note_content", note, "content")]


_INDEXES: dict[tuple, TextIndex] = {}


def text_index(c, stemmed: bool = False) -> TextIndex:
    """The session's index of the catalog's texts. It is made by the first search, and again once the tables' files change."""
    key = (c.spark.sparkContext.applicationId, c.sf_dir, stemmed, c.version("documents", "embeddings", "labels", "conversations"))
    if key not in _INDEXES:
        _INDEXES[key] = TextIndex(_legs(c), stemmed=stemmed)
    return _INDEXES[key]


def _rounded(found):
    return found.withColumn("relevance", F.round("relevance", 6))


@query("text_search_common_words", _text_sql(_LEGS, ["the", "and"], None), "source", "source_embedding", "source_insight", "note")
def common(c):
    # No limit: the whole ranking is given.
    return _rounded(text_index(c).search("the and"))


@query("text_search_labels", _text_sql(_LEGS, ["label"], None), "source", "source_embedding", "source_insight", "note")
def labels(c):
    return _rounded(text_index(c).search("label"))


@query("text_search_full_text_top", _text_sql([(_SOURCE, "full_text")], ["that", "with"], 25), "source")
def top_texts(c):
    return _rounded(text_index(c).search("that with", 25, ["source_text"]))


def _response_sql(flags: str, legs: list, n: int) -> str:
    return f"SELECT '{flags}' AS flags, *, count(*) OVER () AS total_count FROM ({_text_sql(legs, ['the'], n)})"


@query("search_response_by_flags", " UNION ALL ".join(f"({_response_sql(*x)})" for x in (("sources", _LEGS[:4], 40), ("notes", _LEGS[4:], 40), ("both", _LEGS, 1000))), "source", "source_embedding", "source_insight", "note")
def by_flags(c):
    """One keyword searched in sources, in notes, in both and in neither, with the number of results given."""
    def asked(flags, sources, notes, limit):
        found = search.search("text", " The?", text_index(c), limit=limit, sources=sources, notes=notes)
        return search.search_response(found, "text").select(F.lit(flags).alias("flags"), "id", "parent_id", "title", F.round("relevance", 6).alias("relevance"), "total_count")
    return asked("sources", True, False, 40).unionAll(asked("notes", False, True, 40)).unionAll(asked("both", True, True, 1000)).unionAll(asked("neither", False, False, 40))


_BY_SQL = f"SELECT 'found' AS asked, * FROM ({_text_sql(_LEGS, ['the', 'and'], 30)}) UNION ALL SELECT 'notes', * FROM ({_text_sql(_LEGS[4:], ['that'], 1000000)})"


@query("stored_search_function", _BY_SQL, "source", "source_embedding", "source_insight", "note")
def stored_function(c):
    """The search as a table function that SQL calls in FROM."""
    text_index(c).create_function("text_search")
    return _rounded(c.spark.sql("SELECT 'found' AS asked, * FROM text_search('the and', 30, true, true) UNION ALL SELECT 'notes', * FROM text_search('That', 1000000, false, true)"))


@query("text_search_inflections")
def inflections(c):
    """A search in the stemmed index: other forms of the words are found too."""
    return _rounded(text_index(c, stemmed=True).search("Labelled"))


_Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
_COS = "round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])), 9)"


def _vector_sql(n: int, minimum: float) -> str:
    legs = [
        "SELECT e.id AS row_id, s.id, s.id AS parent_id, s.title, e.content, e.embedding FROM source_embedding AS e LEFT JOIN source AS s ON s.id = e.source",
        "SELECT i.id AS row_id, i.id, s.id AS parent_id, i.insight_type || ' - ' || coalesce(s.title, '') AS title, i.content, i.embedding FROM insight_vectors AS i LEFT JOIN source AS s ON s.id = i.source",
        "SELECT id AS row_id, id, id AS parent_id, title, content, embedding FROM note_vectors",
    ]
    tops = [f"(SELECT id, parent_id, title, content, {_COS} AS similarity FROM ({leg}), {_Q} WHERE {_COS} >= {minimum} ORDER BY similarity DESC, row_id LIMIT {n})" for leg in legs]
    return f"SELECT id, parent_id, title, round(max(similarity), 6) AS similarity, list_sort(list(content)) AS matches FROM ({' UNION '.join(f'SELECT * FROM {x}' for x in tops)}) WHERE id IS NOT NULL GROUP BY id, parent_id, title ORDER BY max(similarity) DESC, id LIMIT {n}"


@query("vector_search_three_legs", _vector_sql(40, 0.05), "source", "source_embedding", "source_insight", "insight_vectors", "note", "note_vectors")
def vectors(c):
    q = [float(x) for x in c.raw("embeddings").where("vec_id = 0").select("embedding").first()[0]]
    return search.vector_search(list(_vector_legs(c).values()), q, 40, 0.05).withColumn("similarity", F.round("similarity", 6))


def _vector_legs(c):
    titles = c.source().select(F.col("id").alias("source"), "title")
    titled = lambda top: titles.join(F.broadcast(top), "source", "right")  # noqa: E731  at most as many rows as are searched for
    known = F.when(F.col("title").isNotNull(), F.col("source"))
    chunk = lambda top: titled(top).withColumn("id", known).withColumn("parent_id", known)
    insight = lambda top: titled(top).withColumns({"id": F.col("row_id"), "parent_id": known, "title": F.concat("insight_type", F.lit(" - "), F.coalesce("title", F.lit("")))})
    note = lambda top: top.withColumns({"id": F.col("row_id"), "parent_id": F.col("row_id")})
    row = lambda df, *columns: df.select(F.col("id").alias("row_id"), *columns, "content", "embedding")
    return {"source_chunk": (row(c.source_embedding(), "source"), chunk), "source_insight": (row(c.insight_vectors(), "source", "insight_type"), insight), "note": (row(c.note_vectors(), "title"), note)}


_ASK = f"""
SELECT term, id, rank FROM (SELECT q.vec_id AS term, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id)::INT AS rank
FROM (SELECT * FROM embeddings WHERE vec_id < 5) AS q, embeddings AS e) WHERE rank <= 10
"""


@query("ask_terms_top_ten", _ASK)
def ask(c):
    """A stated set of five search vectors, each with its ten nearest rows."""
    e = c.raw("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = e.where("vec_id < 5").select(F.col("vec_id").alias("term"), F.col("v").alias("q"))
    score = F.round(F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 9)
    pairs = e.join(F.broadcast(q)).select("term", F.col("vec_id").alias("id"), score.alias("score"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "id"))).where("rank <= 10").select("term", "id", "rank")


@query("embedding_rebuild_ids", "SELECT 'source' AS kind, id FROM source WHERE full_text IS NOT NULL AND id IN (SELECT source FROM source_embedding) UNION ALL SELECT 'note', id FROM note_vectors WHERE embedding IS NOT NULL AND len(embedding) > 0 UNION ALL SELECT 'insight', id FROM insight_vectors WHERE len(embedding) > 0", "source", "source_embedding", "note", "note_vectors", "source_insight", "insight_vectors")
def rebuild(c):
    full = lambda df, kind: df.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.lit(kind).alias("kind"), "id")
    sources = c.source().where("full_text IS NOT NULL").join(c.source_embedding().select(F.col("source").alias("id")), "id", "left_semi").select(F.lit("source").alias("kind"), "id")
    return sources.unionAll(full(c.note_vectors(), "note")).unionAll(full(c.insight_vectors(), "insight"))


def _rank_sql(rounds: int) -> str:
    steps = ["e AS (SELECT DISTINCT out AS a, \"in\" AS b FROM reference)", "v AS (SELECT a AS id FROM e UNION SELECT b FROM e)", "o AS (SELECT a, count(*) AS k FROM e GROUP BY a)", "n AS (SELECT count(*) AS n FROM v)", "r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS (SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE id NOT IN (SELECT a FROM o)) / n) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT e.b AS id, sum(r.rank / o.k) AS got FROM e JOIN r{i - 1} AS r ON r.id = e.a JOIN o ON o.a = e.a GROUP BY e.b) AS g ON g.id = v.id)")
    return f"WITH {', '.join(steps)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query("page_rank_of_references", _rank_sql(3), "reference")
def ranks(c):
    edges = c.reference().select(F.col("out").alias("in"), F.col("in").alias("out"))
    return graph.page_rank(edges, rounds=3).withColumn("rank", F.round("rank", 9))
