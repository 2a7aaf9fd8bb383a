import re
from html import unescape

from pyspark.sql import functions as F

from tesserae.functions.markdown import markdown
from tesserae.functions.split import split
from tesserae.operators.ingest import extracted, ingested, vectorised, with_insights

EMBED = lambda c: F.array(F.length(c).cast("double"), F.size(F.split(c, " ")).cast("double"))
HOW = {"first line": lambda t: F.substring_index(t, "\n", 1), "nothing": lambda t: F.lit("")}


def test_pages_to_insights(spark):
    long = "<h1>Long</h1>" + "".join(f"<p>{'word ' * 90}{i}.</p>" for i in range(30))
    pages = [("p1", "<h2>Head</h2><p>text</p>"), ("p2", long), ("p3", "<p>no heading</p>"), ("p4", None), ("p5", "<script>x</script>")]
    out = {k: v.collect() for k, v in ingested(spark.createDataFrame(pages, "id string, html string"), HOW, EMBED).items()}
    texts = {i: markdown(h) for i, h in pages}
    assert {r.id: (r.title, r.full_text) for r in out["sources"]} == {i: ({"p1": "Head", "p2": "Long"}.get(i), t) for i, t in texts.items()}
    want = sorted((i, n, c, [float(len(c)), float(len(c.split(" ")))]) for i, t in texts.items() for n, c in enumerate(split(t)))
    assert sorted((r.source, r.order, r.content, r.embedding) for r in out["chunks"]) == want and sum(w[0] == "p2" for w in want) > 3
    firsts = {i: t.split("\n")[0] for i, t in texts.items() if t}
    assert {r.source: r.content for r in out["insights"]} == firsts and len({r.id for r in out["insights"]}) == len(firsts)
    assert sorted((r.source, r.insight_type, r.problem) for r in out["refused"]) == sorted([(i, "nothing", "no content") for i, _ in pages] + [(i, "first line", "no content") for i in ("p4", "p5")])


def test_vectorising_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", 0, "old", [1.0]), ("b", 0, "stays", [2.0])], "source string, `order` long, content string, embedding array<double>")
    sources = spark.createDataFrame([("a", "new text"), ("c", "  "), ("a2", None)], "id string, full_text string")
    once = vectorised(sources, old, EMBED)
    want = [("a", 0, "new text"), ("b", 0, "stays")]
    assert sorted((r.source, r.order, r.content) for r in once.collect()) == want
    assert sorted((r.source, r.order, r.content) for r in vectorised(sources, once, EMBED).collect()) == want


def test_insights_need_a_type_and_a_content(spark):
    new = spark.createDataFrame([("s", "summary", "said"), ("s", None, "x"), ("s", "", "x"), ("s", "summary", None), (None, "t", "lost")], "source string, insight_type string, content string")
    blank = spark.createDataFrame([], "id string, source string, insight_type string, content string, embedding array<double>")
    made, refused = with_insights(blank, new)
    assert sorted((r.content, r.embedding) for r in made.collect()) == [("lost", []), ("said", [])]
    assert sorted(r.problem for r in refused.collect()) == ["no content", "no type", "no type"]


def test_given_pages_have_their_headings(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.id: r.title for r in extracted(pages, "page_id").collect()}
    heads = {r.page_id: unescape(re.search("<h1>(.*?)</h1>", r.html)[1]).strip() for r in pages.collect()}
    assert got == heads
