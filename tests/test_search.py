import pytest

from tesserae.operators.search import text_search
from tesserae.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["text_search_common_words", "text_search_labels"])
def test_whole_ranking_has_no_limit(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan and "LocalLimit" not in plan and "Sort [" in plan


def test_limit_is_optional(spark):
    rows = spark.range(30).selectExpr("string(id) AS id", "string(id) AS parent_id", "'t' AS title", "repeat('word ', int(id) + 1) AS text")
    assert text_search([(rows, "text")], ["word"]).count() == 30
    assert text_search([(rows, "text")], ["word"], 7).count() == 7
