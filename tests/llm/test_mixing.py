import math
import random
import re

import pytest

from tesserae.llm import mixing
from tesserae.llm.mixing import mix, mixture

SF = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))


def targets(sizes, share, weights, most):
    """sizes: by source. The shares by weight, filled round by round."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out = share * sum(sizes.values()), {}
    while len(out) < len(order):
        free = [s for s in order if s not in out]
        left = total - sum(out.values())
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level >= most * sizes[s]]
        out |= {s: most * sizes[s] for s in full} if full else {s: weight[s] * level for s in free}
    return out


def rates(sizes, target, even, most):
    """Rates of one source's documents by bisection of the dual."""
    total = sum(sizes)
    if not total or target >= most * total * (1 - 1e-12):
        return [most] * len(sizes)
    mean = total / len(sizes)
    rate = lambda x, n: min(most, even * math.exp(min(700, x * n / mean)))
    low, high = -1e5, 1e5
    for _ in range(300):
        x = (low + high) / 2
        low, high = (x, high) if sum(n * rate(x, n) for n in sizes) < target else (low, x)
    return [rate(x, n) for n in sizes]


def held(spark, rows, got, share=1.5, weights=(3, 1, 2), most=2):
    by = {}
    for _, source, text in rows:
        by.setdefault(source, []).append(words(text))
    want = targets({s: sum(n) for s, n in by.items()}, share, weights, most)
    assert len(got) == len(rows)
    for source, n in by.items():
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {sum(n)} and all(r.target == pytest.approx(want[source], rel=1e-9) for r in own)
        rate = dict(zip(n, rates(n, want[source], share, most), strict=True))
        assert all(r.rate == pytest.approx(rate[r["size"]], rel=1e-5, abs=1e-9) for r in own)
        assert all(r.taken == r.copies * r["size"] <= most * r["size"] and r.copies >= 0 for r in own)
        # The words taken are as near as whole copies of the smallest documents allow, where large ones leave room.
        if len(n) > 20:
            assert abs(sum(r.taken for r in own) - want[source]) <= max(10, 0.002 * want[source])


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["b", "b", "b", "a", "é", "z", None]), "w " * int(r.paretovariate(0.9) + r.randrange(3))) for i in range(600)]
    rows += [(1000, "empty", None), (1001, "empty", ""), (None, "b", "x y"), (5, "b", "again and again"), (5, "b", "again and again"), (7, "one", "a b c")]
    docs = spark.createDataFrame([(i, s, t, 0, "x", 1.0) for i, s, t in rows], "doc_id long, source string, text string, size int, rate string, sid double")
    got = mix(docs.repartition(5)).collect()
    held(spark, rows, got)
    again = sorted((str(x.doc_id), x["size"], x.taken) for x in mix(docs.repartition(2)).collect())
    assert again == sorted((str(x.doc_id), x["size"], x.taken) for x in got)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.select("doc_id", "source", "text").collect()]
    got = mix(docs).collect()
    held(spark, rows, got)
    by = {}
    for r in got:
        by.setdefault((r.source, r.target), []).append(r)
    for (_, target), own in by.items():
        smallest = min(r["size"] for r in own if r["size"])
        assert abs(sum(r.taken for r in own) - target) <= max(2 * smallest, 0.02 * target)


def test_parts_of_a_large_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 16)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "w " * (i * 7919 % 97)) for i in range(900)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    held(spark, rows, got)


def test_sources_that_are_not_few(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    rows = [(i, None if i % 5 == 0 else f"s{i % 40}", "w " * (i % 23)) for i in range(1500)]
    held(spark, rows, mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect(), most=2)


def test_other_shares_and_the_documents(spark):
    rows = [(i, f"s{i % 4}", "w " * (1 + i % 31)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mix(docs, share=0.5, weights=(1, 5), most=3)
    held(spark, rows, mixed.collect(), 0.5, (1, 5), 3)
    assert mixture(docs, mixed).count() == sum(r.copies for r in mixed.collect())


def test_empty_table_and_no_words(spark):
    schema = "doc_id long, source string, text string"
    assert mix(spark.createDataFrame([], schema)).collect() == []
    got = mix(spark.createDataFrame([(1, "a", None), (2, None, "")], schema)).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
