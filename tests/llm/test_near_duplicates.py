import random

import pytest

from tesserae.llm import common
from tesserae.llm.components import components
from tesserae.llm.near_duplicates import near_duplicates, prefix, retained, tail, without_near_duplicates


def shingles(text, k=4):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, num=80, den=100, shingle=4):
    sets = [shingles(t, shingle) for _, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for p, (i, _) in enumerate(rows):
        for q in range(p):
            j = rows[q][0]
            if i is not None and j is not None and sets[p] and sets[q] and den * len(sets[p] & sets[q]) >= num * len(sets[p] | sets[q]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def family(r, size, copies, edits):
    base = [str(r.randrange(10**6)) for _ in range(size)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(size)] = str(r.randrange(10**6))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("seed", "broadcast"), [(1, 10**6), (2, 0)])
def test_against_brute_force(spark, seed, broadcast, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    r = random.Random(seed)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(r.randrange(1, 80))) for _ in range(40)]
    texts += family(r, 120, 60, 2) + family(r, 200, 40, 4) + family(r, 12, 30, 1) + family(r, 300, 6, 7)
    chain = [str(r.randrange(10**6)) for _ in range(400)]
    texts += [" ".join(chain[i : i + 200]) for i in range(0, 200, 15)]
    line = " ".join(str(r.randrange(10**6)) for _ in range(30))
    texts += [line + " " + " ".join(str(r.randrange(10**6)) for _ in range(k % 25)) for k in range(80)]
    texts += [None, "", " ", "one", "One", "one two three", "ONE two\tthree", "É é", "é É"] + texts[:10] * 3
    r.shuffle(texts)
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[3])]
    d = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, kept double")
    assert sorted((tuple(x) for x in near_duplicates(d, exact=seed == 2).collect()), key=str) == brute(rows)


def test_similar_sets_always_meet():
    """Whatever each set leaves out of its retained values, the most frequent in any one order, a common one is left."""
    r = random.Random(5)
    keeps, outs = retained(80, 100, True)
    for n in [*range(1, 90), 130, 190, 240, 400, 1000]:
        for _ in range(6):
            m = r.randint(-(-n * 80 // 100), n)  # the smaller set; as few in common as similarity allows
            both = next(x for x in range(m + 1) if 100 * x >= 80 * (n + m - x))
            if both > m:
                continue
            pool = r.sample(range(10**9), n + m - both)
            r.shuffle(pool)
            if r.random() < 0.5:  # the worst case: what is not common comes first
                pool[:both], pool[both:] = sorted(pool)[-both:], sorted(pool)[:-both]
            a, b = set(pool[:n]), {*pool[:both], *pool[n:]}
            kept = [sorted(x)[: keeps[len(x)]] for x in (a, b)]
            often = {v: r.random() + (v in a and v in b) for v in a | b}
            left = [set(sorted(x, key=often.get)[: len(x) - outs[size]]) for x, size in zip(kept, (len(a), len(b)), strict=True)]
            assert left[0] & left[1], (n, m, both)
    assert prefix(10, 80, 100) == 3 and tail(80, 100, 64, 1e-9) > 25 and tail(80, 100, 10, 1e-9) == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3), (400, 390), (390, 380)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(200, 260)} | {400: 380, 390: 380}


def test_empty_tables(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect() == [(1, 0, 1, True)]


def test_of_a_repeated_id_one_stated_row_stays(spark):
    rows = [(1, "b b b b b", "x"), (1, "a a a a a", "z"), (1, "a a a a a", "y"), (1, None, "n"), (2, "a a a a a", "w"), (3, "other words are here", "v"), (None, "a a a a a", "u")]
    for parts in (1, 5):
        kept = without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts))
        assert sorted((tuple(r) for r in kept.collect()), key=str) == [(1, "a a a a a", "y"), (3, "other words are here", "v"), (None, "a a a a a", "u")]
