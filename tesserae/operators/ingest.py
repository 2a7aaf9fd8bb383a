"""Ingest: sources from pages, their chunks with vectors, and insights. Models are functions of columns that the caller gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.markdown import to_markdown
from tesserae.functions.split import split_text


def extracted(pages: DataFrame, id_col: str = "id", html_col: str = "html") -> DataFrame:
    """(id, title, full_text) of web pages: the text as markdown, the title its first heading, null without one."""
    text = pages.select(F.col(id_col).alias("id"), to_markdown(F.col(html_col)).alias("full_text"))
    heading = F.regexp_extract(F.coalesce("full_text", F.lit("")), r"(?m)^#{1,6} (.+)$", 1)
    return text.select("id", F.when(heading != "", heading).alias("title"), "full_text")


def vectorised(sources: DataFrame, old: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(source, order, content, embedding): the chunks of ``old`` without those of these sources (id, full_text), and the sources' texts
    cut into chunks anew, in order, each with its vector. A text without content leaves none. Repeating it changes nothing."""
    fresh = sources.select(F.col("id").alias("source"), F.posexplode(split_text("full_text")).alias("order", "content"))
    fresh = fresh.select("source", F.col("order").cast("long").alias("order"), "content").withColumn("embedding", embed(F.col("content")))
    kept = old.join(sources.select(F.col("id").alias("source")).distinct(), "source", "left_anti")
    return kept.select("source", "order", "content", "embedding").unionByName(fresh)


def with_insights(insights: DataFrame, new: DataFrame, embed: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(insights with the new ones, new ones that are refused with their ``problem``). ``new`` has source, insight_type and content; one
    without a type or a content is refused. Without a model the vector is empty. An insight's id is made of its source, type and content."""
    problem = F.when(F.coalesce(F.col("insight_type"), F.lit("")) == "", "no type").when(F.coalesce(F.col("content"), F.lit("")) == "", "no content")
    checked = new.select("source", "insight_type", "content", problem.alias("problem"))
    key = F.concat(F.lit("source_insight:"), F.md5(F.concat_ws("\0", F.coalesce("source", F.lit("")), "insight_type", "content").cast("binary")))
    vector = embed(F.col("content")) if embed else F.array().cast("array<double>")
    made = checked.where("problem IS NULL").select(key.alias("id"), "source", "insight_type", "content").withColumn("embedding", vector)
    return insights.unionByName(made), checked.where("problem IS NOT NULL")


def ingested(pages: DataFrame, transformations: dict[str, Callable[[Column], Column]], embed: Callable[[Column], Column], id_col: str = "id", html_col: str = "html") -> dict[str, DataFrame]:
    """Pages to sources, their chunks, and one insight for each transformation that says something; ``refused`` are those that don't."""
    sources = extracted(pages, id_col, html_col)
    none = sources.sparkSession.createDataFrame([], "source string, `order` long, content string, embedding array<double>")
    chunks = vectorised(sources, none, embed)
    said = F.explode(F.array(*(F.struct(F.lit(name).alias("insight_type"), made(F.col("full_text")).alias("content")) for name, made in transformations.items())))
    blank = sources.sparkSession.createDataFrame([], "id string, source string, insight_type string, content string, embedding array<double>")
    insights, refused = with_insights(blank, sources.select(F.col("id").alias("source"), said.alias("s")).select("source", "s.*"), embed)
    return {"sources": sources, "chunks": chunks, "insights": insights, "refused": refused}
