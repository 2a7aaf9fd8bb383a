"""Python sees few rows at a time where rows are long."""

from pyspark.sql import functions as F

from tesserae.functions.markdown import to_markdown
from tesserae.functions.split import split_text


def test_texts_go_to_python_by_the_hundred(spark):
    rows = spark.range(3).select(F.lit("text").alias("t"))
    for made in (split_text("t"), to_markdown("t")):
        plan = rows.select(made)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
