"""Full-text search by BM25 and vector search by cosine, over several legs that are united."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import analyse
from tesserae.operators.postings import K1, B, TextIndex


def bm25(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """``rows`` with ``score``, those in which every term occurs, without an index: for texts searched once. Statistics and scores come from two scans and no shuffle
    but that of one row for each task: only the query's terms are counted, never all postings."""
    terms = list(dict.fromkeys(terms))
    tokens = lambda df: df.withColumn("_tokens", F.array_remove(analyse(F.coalesce(F.col(text), F.lit(""))), ""))
    count = lambda df: df.select(*rows.columns, F.size("_tokens").alias("_len"), *(_count("_tokens", t).alias(f"_tf{i}") for i, t in enumerate(terms)))
    counted = count(tokens(rows))
    # Only texts that hold the letters of every term are cut into tokens again.
    holds = reduce(lambda a, b: a & b, (F.contains(F.lower(F.col(text)), F.lit(t)) for t in terms))
    near = count(tokens(rows.where(holds)))
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))))
    hits = near.where(reduce(lambda a, b: a & b, (F.col(f"_tf{i}") > 0 for i in range(len(terms))))).join(F.broadcast(stats))

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        tf = F.col(f"_tf{i}")
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))

    return hits.select(*rows.columns, reduce(lambda a, b: a + b, (part(i) for i in range(len(terms)))).alias("score"))


def _count(tokens: str, term: str) -> Column:
    return F.size(F.array_compact(F.transform(tokens, lambda x: F.when(x == F.lit(term), F.lit(1)))))


def text_search(legs: list[tuple[DataFrame, str]], terms: list[str], n: int | None = None) -> DataFrame:
    """(id, parent_id, title, relevance): each leg's best score by row, legs united, the best by result, the first ``n`` or all.

    A leg is (rows with id, parent_id and title, text column).
    """
    found = [bm25(rows, text, terms).groupBy("id", "parent_id", "title").agg(F.max("score").alias("relevance")) for rows, text in legs]
    union = reduce(DataFrame.unionByName, found).where("id IS NOT NULL")
    ranked = union.groupBy("id", "parent_id", "title").agg(F.max("relevance").alias("relevance")).orderBy(F.desc("relevance"), "id")
    return ranked if n is None else ranked.limit(n)


def cosine(vector: str, query: list[float]) -> Column:
    """Cosine with a fixed vector, whose norm is worked out once here. Null where the widths differ."""
    q = F.array(*map(F.lit, query))
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(vector) == len(query), dot / norm / math.sqrt(sum(x * x for x in query)))


def vector_leg(rows: DataFrame, query: list[float], n: int, minimum: float, vector: str = "embedding") -> DataFrame:
    """The leg's ``n`` most similar rows of at least ``minimum``, with their similarity and without the vector."""
    kept = rows.where(F.col(vector).isNotNull() & (F.size(vector) == len(query))).withColumn("similarity", F.round(cosine(vector, query), 9)).drop(vector)
    return kept.where(F.col("similarity") >= minimum).orderBy(F.desc("similarity"), "row_id").limit(n)


def vector_search(legs: list[tuple[DataFrame, Callable[[DataFrame], DataFrame]]], query: list[float], n: int, minimum: float = 0.2) -> DataFrame:
    """(id, parent_id, title, similarity, matches). A leg is rows with row_id, content and embedding, and what makes id, parent_id
    and title of its best rows: only those are joined with their titles. ``n`` limits rows in each leg before they are grouped,
    so fewer results may come."""
    columns = ["id", "parent_id", "title", "content", "similarity"]
    found = reduce(DataFrame.unionByName, (named(vector_leg(rows, query, n, minimum)).select(*columns) for rows, named in legs)).distinct().where("id IS NOT NULL")
    grouped = found.groupBy("id", "parent_id", "title").agg(F.max("similarity").alias("similarity"), F.sort_array(F.collect_list("content")).alias("matches"))
    return grouped.orderBy(F.desc("similarity"), "id").limit(n)


def highlighted(text: Column, terms: list[str], mark: str = "`") -> Column:
    """The text with each whole word that is a term, in any case, between marks. A term is plain text, whatever its letters;
    without a term the text stays as it is."""
    plain = [re.sub(r"([^\w\s])", r"\\\1", t) for t in sorted(terms, key=len, reverse=True) if t]
    if not plain:
        return text
    return F.regexp_replace(text, rf"(?iU)(?<!\w)({'|'.join(plain)})(?!\w)", f"{mark}$1{mark}")


def search(
    kind: str, keyword: str, texts: TextIndex | None = None, vector_legs: dict | None = None, embed: Callable[[str], list[float]] | None = None, limit: int = 100, minimum: float = 0.2,
    sources: bool = True, notes: bool = True,
) -> DataFrame:
    """Text or vector search for a keyword: a blank keyword, an unknown kind or a limit above 1000 is an error. The keyword is
    cut into terms like the texts; ``embed`` gives its vector. Legs whose names begin with "note" are searched if ``notes``,
    all others if ``sources``. The rows have final_score; the best come first."""
    if not keyword.strip():
        raise ValueError("a search needs a keyword")
    if limit > 1000:
        raise ValueError("the limit is at most 1000")
    if kind not in ("text", "vector"):
        raise ValueError(f"search is text or vector, not {kind}")
    wanted = [name for name in (texts.names if kind == "text" else vector_legs) if (notes if name.startswith("note") else sources)]
    if kind == "text":
        found = texts.search(keyword, limit, wanted) if wanted else texts.search([], limit)
    elif wanted:
        found = vector_search([vector_legs[name] for name in wanted], embed(keyword), limit, minimum)
    else:
        found = vector_search(list(vector_legs.values()), embed(keyword), limit, minimum).where("false")
    return reranked(found)


def search_response(found: DataFrame, kind: str) -> DataFrame:
    """The results of search() with total_count, which is of the results given (so of 1000 at most), not of all hits, and search_type."""
    total = F.broadcast(found.agg(F.count("*").alias("total_count")))
    return found.join(total).withColumn("search_type", F.lit(kind))


def reranked(found: DataFrame) -> DataFrame:
    """final_score: the first of relevance, similarity and score that is there, else 0; the best first."""
    scores = [F.col(c).cast("double") for c in ("relevance", "similarity", "score") if c in found.columns]
    return found.withColumn("final_score", F.coalesce(*scores, F.lit(0.0))).orderBy(F.desc("final_score"), "id")
