"""Unit vectors and edge cases of the text functions and row operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import text as t
from tesserae.functions.versions import compare_versions
from tesserae.operators import context, graph, rows, search
from tesserae.streaming import jobs


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"x{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(f"x{i}") for i in range(len(values)))).alias("y")).first()["y"]


@pytest.mark.parametrize(("said", "kept"), [("rivière Ω and 東京 rain ☂ ends", "rivire  and  rain  ends"), ("plain 9 (text) ~ only", "plain 9 (text) ~ only"), ("ßß", ""), ("", ""), (None, None)])
def test_remove_non_ascii(spark, said, kept):
    assert one(spark, t.remove_non_ascii, said) == kept


@pytest.mark.parametrize(("said", "kept"), [("one\ttwo\nthree", "one\ttwo\nthree"), ("\u2003a\u3000b\u200bc\u2028d\x07 ", "a b c\nd"), ("p\xa0q\xa0", "p q"), ("zoë_7%8", "zoë_78")])
def test_remove_non_printable(spark, said, kept):
    assert one(spark, t.remove_non_printable, said) == kept


@pytest.mark.parametrize(
    ("said", "thinking", "cleaned"),
    [("<think>weigh both sides</think>The second one.", "weigh both sides", "The second one."), ("nothing was weighed here", "", "nothing was weighed here"), (None, "", ""), ("x" * 200_000, "", "x" * 200_000), ("<think>a</think> b <think>\nc</think>", "a\n\nc", "b")],
)
def test_parse_thinking(spark, said, thinking, cleaned):
    assert one(spark, lambda c: t.parse_thinking(c)[0], said) == thinking
    assert one(spark, lambda c: t.parse_thinking(c)[1], said) == cleaned


def test_token_estimate(spark):
    assert one(spark, t.token_estimate, "one two three four five") == 6
    assert one(spark, t.token_estimate, None) == 0


@pytest.mark.parametrize(
    ("a", "b", "sign"),
    [("3.2", "3.2", 0), ("0.9", "3.2", -1), ("3.2.1", "3.3", -1), ("7.0.4", "7.0.5", -1), ("12", "9.9", 1), ("4.1", "4.1-alpha", 1), ("4.1-beta2", "4.1-alpha7", 1), ("6.0.0", "6", 0), ("2.10", "2.9", 1), ("5.0rc3", "5.0rc1", 1), ("1.2.3.4.5.6.7.1", "1.2.3.4.5.6.7", 1), ("1.2.3.4.5.6.7.0", "1.2.3.4.5.6.7", 0), ("0.0", "0", 0)],
)
def test_compare_versions(spark, a, b, sign):
    assert one(spark, compare_versions, a, b) == sign


@pytest.mark.parametrize(("url", "path"), [("file:///a/b%20c+d", "/a/b c+d"), ("/plain+x", "/plain+x"), (None, None)])
def test_file_path(spark, url, path):
    assert one(spark, t.file_path, url) == path


def test_with_prefix_and_references(spark):
    assert one(spark, lambda c: t.with_prefix(c, "source"), "7") == "source:7"
    assert one(spark, lambda c: t.with_prefix(c, "source"), "source:7") == "source:7"
    assert one(spark, t.references, "see source:a1, [note:b] and x:1 source_insight:c_2") == ["source:a1", "note:b", "source_insight:c_2"]
    assert one(spark, t.linked_references, "[[note:b]] source:c") == "[note:b](#ref-note-b) [source:c](#ref-source-c)"


def table(spark, *values):
    return spark.createDataFrame(values, "id string, a int, b string")


def test_row_operators(spark):
    x = table(spark, ("1", 1, "p"), ("2", None, None))
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(rows.update_merge(x, table(spark, ("2", 5, None), ("3", 9, "z")))) == {("1", 1, "p"), ("2", 5, None)}
    assert as_set(rows.upsert_merge(x, table(spark, ("2", 5, None), ("3", 9, "z")))) == {("1", 1, "p"), ("2", 5, None), ("3", 9, "z")}
    assert as_set(rows.insert_batch_or_nothing(x, table(spark, ("1", 0, "n"), ("4", 0, "n")))) == as_set(x)
    assert as_set(rows.insert_batch_or_nothing(x, table(spark, ("4", 0, "n")))) == as_set(x) | {("4", 0, "n")}
    assert as_set(rows.delete_where(x, F.col("a") == 1)) == {("2", None, None)}
    assert as_set(rows.update_where(x, F.col("a") == 1, b=F.lit("q"))) == {("1", 1, "q"), ("2", None, None)}
    with pytest.raises(ValueError, match="limit"):
        rows.page(x, [F.col("id")], 0, 0)


def test_graph_operators(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "b")], "in string, out string")
    nodes = spark.createDataFrame([("a", "wide"), ("b", "wide")], "id string, text string")
    assert [tuple(r) for r in graph.outgoing(edges, "a", nodes, ("text",)).collect()] == [("b",), ("b",)]
    assert {(r.id, r.links) for r in graph.degrees(nodes.select("id"), links=edges).collect()} == {("a", 1), ("b", 3)}
    assert {(r.id, r.hop) for r in graph.hops(edges, spark.createDataFrame([("a",)], "id string"), 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    ranks = {r.id: r["rank"] for r in graph.page_rank(edges, rounds=5, cut=lambda df: df).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and min(ranks, key=ranks.get) == "d"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from(["source", "insight", "note", "x"]), st.integers(0, 9)), min_size=1, max_size=12), st.integers(0, 30))
def test_context_is_the_rule(items, budget):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([("g", i, *x) for i, x in enumerate(items)], "grp string, seq int, id string, type string, tokens int")
    first = {}
    for i, x in enumerate(items):
        first.setdefault(x[0], (i, *x))
    kept = sorted(first.values(), key=lambda x: (-context.PRIORITY.get(x[2], 0), x[0]))
    while kept and sum(x[3] for x in kept) > budget:
        kept.pop()
    assert {r.id for r in context.build_context(df, budget).collect()} == {x[1] for x in kept}


def test_search_edges(spark):
    d = spark.createDataFrame([("1", "Red FoxRuns 7up"), ("2", "red"), ("3", None)], "id string, t string")
    assert {r.id for r in search.bm25(d, "t", ["red"]).collect()} == {"1", "2"}
    assert {r.id for r in search.bm25(d, "t", ["fox", "runs", "up"]).collect()} == {"1"}
    assert search.bm25(d, "t", ["absent"]).count() == 0
    v = spark.createDataFrame([("1", [3.0, 4.0]), ("2", [1.0]), ("3", None)], "id string, v array<float>")
    assert {r.id: r.y for r in v.select("id", search.cosine("v", [3.0, 4.0]).alias("y")).collect()} == {"1": pytest.approx(1.0), "2": None, "3": None}


def test_late_rows_and_batches(spark, tmp_path):
    """Each file is a batch: rows far behind the stream are late, a window's later rows replace its count."""
    for i, ts in enumerate(["2024-01-01 10:05:00", "2024-01-01 10:20:00", "2024-01-01 12:30:00", "2024-01-01 12:35:00", "2024-01-01 10:40:00"]):
        spark.sql(f"SELECT timestamp '{ts}' AS ts, 'new' AS status").coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    like = spark.read.parquet(str(tmp_path / "in")).select("ts", "status")
    events = jobs.read_table_stream(spark, str(tmp_path / "in/part=*"), like, files=1)
    got = jobs.run_to_end(jobs.windowed_counts(events), str(tmp_path), ["start", "status"]).collect()
    assert {(str(r.start), r.n) for r in got} == {("2024-01-01 10:00:00", 2), ("2024-01-01 12:00:00", 2)}


def test_conversations_keep_state_over_batches(spark, tmp_path):
    for i, rows in enumerate([[(1, 0, "user"), (2, 0, "user")], [(1, 1, "assistant")], [(1, 2, "user")]]):
        spark.createDataFrame(rows, "conv_id long, turn long, role string").coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    like = spark.read.parquet(str(tmp_path / "in")).select("conv_id", "turn", "role")
    got = jobs.run_to_end(jobs.conversation_state(jobs.read_table_stream(spark, str(tmp_path / "in/part=*"), like, files=1)), str(tmp_path), ["conv_id"])
    assert sorted(map(tuple, got.collect())) == [(1, 3, 2, "user"), (2, 1, 0, "user")]


def test_search_entry_rules(spark):
    for bad in (("text", " ", 10), ("sound", "x", 10), ("text", "x", 1001)):
        with pytest.raises(ValueError):
            search.search(bad[0], bad[1], limit=bad[2])
    hits = spark.createDataFrame([("a", None, 0.5), ("b", 0.9, 0.1), ("c", None, None)], "id string, relevance double, similarity double")
    assert [tuple(r) for r in search.reranked(hits).select("id", "final_score").collect()] == [("b", 0.9), ("a", 0.5), ("c", 0.0)]
    assert one(spark, lambda c: search.highlighted(c, ["red", "fox"]), "Red foxes, red fox") == "`Red` foxes, `red` `fox`"
    with pytest.raises(ValueError, match="sort"):
        rows.sort_key("updated; drop", ("updated",))


def test_page_rank_of_many_rounds(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    ranks = {r.id: r["rank"] for r in graph.page_rank(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "in string, out string"), rounds=12).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["c"] == pytest.approx(0.05)
