import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators.context import within_budget
from tesserae.operators.running import ranked, running_sums


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_against_a_loop(spark, parts):
    r = random.Random(parts)
    # One group holds most rows; a null is a group, a null value adds nothing.
    rows = [(r.choice(["hot"] * 8 + ["a", None]), i, r.choice([None, 0, 1, 5])) for i in range(500)]
    got = running_sums(spark.createDataFrame(rows, "g string, o int, v long"), ["g"], [F.desc("o")], F.col("v"), parts=parts)
    sums, want = {}, {}
    for g, o, v in sorted(rows, key=lambda x: -x[1]):
        sums[g] = sums.get(g, 0) + (v or 0)
        want[o] = sums[g]
    assert {x.o: x.running for x in got.collect()} == want


def test_no_group_and_no_rows(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(x["rank"] == x.k + 1 for x in ranked(df, [], [F.col("k")]).collect())
    assert ranked(df.where("k < 0"), ["k"], [F.col("k")]).count() == 0


def test_budget_takes_no_whole_group_into_a_task(spark):
    rows = spark.range(4000).selectExpr("'n' AS grp", "id AS seq", "id % 3 AS priority", "id % 11 AS tokens")
    kept = within_budget(rows, 5000, "grp")
    order = sorted(((-(i % 3), i, i % 11) for i in range(4000)))
    total, want = 0, set()
    for _, i, n in order:
        total += n
        if total <= 5000:
            want.add(i)
    assert {x.seq for x in kept.collect()} == want
