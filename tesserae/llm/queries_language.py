"""Query of language identification (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import is_held_out, table
from tesserae.llm.language import fit_languages, identify_language
from tesserae.llm.registry import query


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = is_held_out(docs["doc_id"], 5, 0)
    model = fit_languages(docs.where(~held_out))
    return identify_language(docs, model, carried=[docs["doc_id"], held_out.alias("held_out")])
