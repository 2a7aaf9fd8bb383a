import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tesserae.functions.stem import stem
from tesserae.operators import postings
from tesserae.operators.postings import TextIndex
from tesserae.operators.search import highlighted, search, search_response


def cut(text):
    """Tokens of a text, letter by letter."""
    out, last = [""], ""
    for c in text or "":
        kind = "L" if c.isalpha() else "N" if c.isnumeric() else ""
        if not kind or last and (kind != last or c.isupper() and out[-1] and out[-1][-1].islower()):
            out.append("")
        if kind:
            out[-1] += c
        last = kind
    return [t.lower() for t in out if t]


def brute(legs, words, stemmed=False, n=None):
    forms = (lambda t: stem(t)) if stemmed else (lambda t: t)
    terms, best = {forms(t) for t in cut(words)}, {}
    for rows in legs.values():
        tokens = [[forms(t) for t in cut(r[3])] for r in rows]
        mean = sum(map(len, tokens)) / max(1, len(rows))
        for row, ts in zip(rows, tokens, strict=True):
            if row[0] is None or not terms or not terms <= set(ts):
                continue
            score = 0
            for t in terms:
                df = sum(t in x for x in tokens)
                tf = ts.count(t)
                score += math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / mean))
            best[row[:3]] = max(best.get(row[:3], -1), score)
    return sorted(((round(-s, 9), *k) for k, s in best.items()), key=lambda x: (x[0], x[1]))[:n]


@pytest.fixture(scope="module")
def legs():
    r = random.Random(4)
    words = "Red FoxRuns 7up state-of-the-art running runs ran the and of été x2y Fox fox's nation nationally".split()
    texts = lambda k: [(None if i % 37 == 5 else f"s:{i % (k // 2)}", f"p:{i % 3}" if i % 2 else None, "t" if i % 5 else None, r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randrange(1, 60)))])) for i in range(k)]
    out = {"source_text": texts(300), "note_content": texts(90), "note_title": []}
    return {k: [(i, p if p else None, t, x) for i, p, t, x in v] for k, v in out.items()}


def frames(spark, legs):
    return [(k, spark.createDataFrame(v, "id string, parent_id string, title string, body string").repartition(3), "body") for k, v in legs.items()]


@pytest.mark.parametrize("stemmed", [False, True])
def test_same_ranking_as_brute_force(spark, legs, stemmed, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_BITS", 2)
    index = TextIndex(frames(spark, legs), stemmed=stemmed, buckets=5)
    for words in ["FoxRuns", "7up", "state-of-the-art", "fox runs", "THE and", "x2y été", "running", "nowhere", "(x", "red nowhere"]:
        for n in (None, 3):
            got = [(-x.relevance, x.id, x.parent_id, x.title) for x in index.search(words, n).collect()]
            want = brute(legs, words, stemmed, n)
            assert [x[0] for x in got] == pytest.approx([x[0] for x in want], abs=1e-8)
            if n != 3:  # the last of the best may be one of several that are equal but for rounding
                assert {x[1:]: x[0] for x in got} == pytest.approx({x[1:]: x[0] for x in want}, abs=1e-8)


def test_inflections_are_found_by_stems_only(spark):
    rows = [("s:1", "s:1", "t", "They walked"), ("s:2", "s:2", "t", "walking shoes"), ("s:3", "s:3", "t", "a wall")]
    found = lambda stemmed: {x.id for x in TextIndex(frames(spark, {"source_text": rows}), stemmed=stemmed).search("Walks").collect()}
    assert found(True) == {"s:1", "s:2"} and found(False) == set()


def test_blocks_that_cannot_reach_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_BITS", 3)
    rows = [(f"s:{i}", "p", "t", "word " * (1 + i % 9) + "other " * (200 if i % 64 else 1)) for i in range(2048)]
    index = TextIndex(frames(spark, {"source_text": rows}))
    got = [round(x.relevance, 9) for x in index.search("word", 4).collect()]
    assert got == [round(-x[0], 9) for x in brute({"source_text": rows}, "word")[:4]]
    assert index.scored(["word"], ["source_text"], 4).count() < 600


def test_search_flags_and_counts(spark, legs):
    index = TextIndex(frames(spark, legs))
    ask = lambda **f: search_response(search("text", "The", index, **f), "text").collect()
    notes, sources, both, none = ask(sources=False), ask(notes=False), ask(limit=7), ask(sources=False, notes=False)
    assert [x.relevance for x in notes] == pytest.approx([-x[0] for x in brute({"n": legs["note_content"]}, "the", n=100)], abs=1e-8)
    assert {x.total_count for x in sources} == {len(sources)} and {(x.total_count, x.search_type) for x in both} == {(7, "text")} and none == []


def test_function_in_sql(spark, legs):
    index = TextIndex(frames(spark, legs), buckets=7)
    index.create_function("find_texts")
    for words, n, sources, notes in [("FoxRuns", 5, True, True), ("state-of-the-art", 1000, True, False), ("the", 1000, False, True), ("nowhere", 5, True, True), ("", 5, True, True)]:
        kept = {k: v for k, v in legs.items() if (notes if k.startswith("note") else sources)}
        got = spark.sql(f"SELECT * FROM find_texts('{words}', {n}, {sources}, {notes}) ORDER BY relevance DESC, id").collect()
        assert [x.relevance for x in got] == pytest.approx([-x[0] for x in brute(kept, words, n=n)], abs=1e-8)


def test_postings_are_packed_by_block(spark):
    rows = [(f"s:{i}", "p", "t", f"word word{i % 2}") for i in range(1000)]
    index = TextIndex([("source_text", spark.createDataFrame(rows, "id string, parent_id string, title string, body string").repartition(1), "body")])
    found = index.postings.where("term = 'word'").collect()
    assert len(found) == 8 and sum(x.df for x in found) == 1000 and all(len(x.ats) == len(x.tfs) == len(x.lens) == x.df for x in found)


def test_index_of_nothing(spark):
    index = TextIndex(frames(spark, {"source_text": []}))
    assert index.search("word").collect() == [] and index.search("", 5).collect() == []


@pytest.mark.parametrize(("terms", "said", "shown"), [(["a.b"], "axb a.b", "axb `a.b`"), (["c++"], "c c++ c", "c `c++` c"), (["(x"], "f (x) (xy", "f `(x`) (xy"), ([], "none", "none"), (["été"], "Été étés", "`Été` étés"), (["$1\\"], "a $1\\ b", "a `$1\\` b"), (["red", "red fox"], "red fox", "`red fox`")])
def test_terms_are_marked_as_they_are(spark, terms, said, shown):
    assert spark.createDataFrame([(said,)], "t string").select(highlighted(F.col("t"), terms).alias("x")).first()["x"] == shown


def test_brute_cut():
    assert cut("FoxRuns 7up state-of x2y") == "fox runs 7 up state of x 2 y".split() and re.fullmatch(r"\w+", cut("Été")[0])
