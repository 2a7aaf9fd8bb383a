"""Query of source mixing (11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import table
from tesserae.llm.mixing import mix
from tesserae.llm.registry import query


@query("op11_entropy_balancing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), share=1.5, weights=(3, 1, 2), most=2)
