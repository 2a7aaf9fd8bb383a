import math

import duckdb
import pytest

from tesserae.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    found = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert found.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    columns = sorted(names)
    assert sorted(found.columns) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=str)
    got = sorted((tuple(r) for r in found.select(*columns).collect()), key=str)
    assert len(got) == len(want) and len(want) > 0
    assert [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))][:3] == []
