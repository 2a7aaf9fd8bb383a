import hashlib
import random
import re

import pytest

from tesserae.llm.decontaminate import decontaminate, find_contamination, without_spans

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items, n):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for k, t in items:
            v = words(t)
            for a in range(max(1, len(v) - n + 1) if v else 0):
                part = v[a : a + n]
                for p in range(len(w) - len(part) + 1):
                    if w[p : p + len(part)] == part:
                        hit.update(range(p, p + len(part)))
                        if k is not None:
                            found.add(str(k))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_against_brute_force(spark, block_bytes):
    r = random.Random(3)
    pick = lambda k: r.choice([" ", "-", "\n", ", "]).join(r.choice(["a", "B", "b", "é", "É", "x1", "_"]) for _ in range(k))
    items = [(k, pick(r.randrange(1, 14))) for k in range(12)] + [(90, None), (91, ""), (92, "--"), (3, pick(5)), (93, pick(40))]
    docs = [(k, pick(r.randrange(0, 60))) for k in range(40)] + [(100, None), (101, ""), (102, "Q " * 300 + items[-1][1]), (102, "Q " * 3000 + items[-1][1]), (None, items[-1][1])]
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, items string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(d, b, n=4, block_bytes=block_bytes).drop("spans", "items")
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(docs, items, 4)
    clean = decontaminate(d, b, n=4, block_bytes=block_bytes)
    assert clean.columns == d.columns
    assert sorted((x.doc_id for x in clean.collect()), key=str) == sorted((x[0] for x in brute(docs, items, 4) if not x[-1]), key=str)


def test_spans_are_removed(spark):
    d = spark.createDataFrame([(1, "Keep this. One, TWO three four! And that", 1), (2, "one two three", 2), (3, None, 3)], "doc_id long, text string, row int")
    b = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert sorted(map(tuple, decontaminate(d, b, remove="spans", n=4).collect())) == [(1, "Keep this. ! And that", 1), (2, "one two three", 2), (3, None, 3)]
    assert without_spans("a b c", [(0, 1), (2, 3)]) == " b "


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert find_contamination(d.limit(0), b).count() == 0
    assert [r.contaminated for r in find_contamination(d, b.limit(0)).collect()] == [False]
