import math

import duckdb
import pytest

from tesserae.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    pick = [[c[0] for c in want.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in pick) for r in want.fetchall()), key=str)
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == columns
    got = sorted((tuple(r) for r in found.select(*columns).collect()), key=str)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
