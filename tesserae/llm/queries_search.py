"""Query of nearest-neighbour search (1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import table
from tesserae.llm.neighbours import nearest
from tesserae.llm.registry import query


@query("op1_vantage_point_search")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
