import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import neighbours
from tesserae.llm.neighbours import nearest


def brute(rows, is_query, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in good:
        if is_query(i):
            near = sorted((-float((q * x).sum()), j) for j, x in good if j != i and len(x) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows], "vec_id long, embedding array<float>, score double, shard int")


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_factor_one_is_exact(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    monkeypatch.setattr(neighbours, "GROUP_SHARDS", 3)
    r = np.random.default_rng(4)
    x = np.float32(np.concatenate([r.normal(size=(200, 6)), r.normal(size=(100, 6)) * 0.05 + 1, np.repeat(r.normal(size=(2, 6)), 40, axis=0)]))
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 6), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6), (1005, []), (None, rows[0][1]), (1010, [1.0, 2.0]), (1015, [3.0, 1.0])]
    got = nearest(table(spark, rows), F.col("vec_id") % 5 == 0, k=20, factor=1.0).collect()
    want = brute(rows, lambda i: i % 5 == 0, 20)
    got = sorted(tuple(g) for g in got)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_recall_of_the_production_factor(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = {w[:1] + w[2:3] for w in brute(rows, lambda i: i % 20 == 0, 20)}
    got = {(g.query_id, g.vec_id) for g in nearest(table(spark, rows), F.col("vec_id") % 20 == 0).collect()}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_empty_and_single(spark):
    assert nearest(table(spark, []), F.lit(True)).count() == 0
    assert nearest(table(spark, [(20, [1.0])]), F.lit(True)).count() == 0


def test_equal_products_at_the_last_place(spark):
    """A hundred different vectors of one product: the least ids are taken; repeated ids are candidates each."""
    r = np.random.default_rng(2)
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [0.5, float(a), float(b)]) for i, (a, b) in zip(range(100, 200), np.float32(r.normal(size=(100, 2)) * 0.1), strict=True)]
    rows += [(300, [0.5, 0.01, 0.0]), (300, [0.5, 0.02, 0.0]), (90, [0.5, 0.0, 0.03])]
    r.shuffle(rows)
    got = sorted((g.rank, g.vec_id) for g in nearest(table(spark, rows), F.col("vec_id") == 0, k=20, factor=1.0).collect())
    assert [i for _, i in got] == [90, *range(100, 119)]
