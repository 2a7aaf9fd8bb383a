"""Query of language-model scoring (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import table
from tesserae.llm.ppm import score_texts
from tesserae.llm.registry import query


@query("op5_ppm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
