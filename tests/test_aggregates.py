from tesserae.plans.queries import QUERIES


def test_titles_are_limited_before_they_are_collected(spark):
    found = QUERIES["kinds_in_lists"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "collect_set" not in plan
    assert all(len(r.titles) == 5 and r.titles == sorted(r.titles) for r in found.collect())
