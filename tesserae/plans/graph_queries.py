"""Queries of paths, communities and ranks over all links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import graph
from tesserae.plans.registry import query

_BOTH = "e AS MATERIALIZED (SELECT \"in\" AS a, out AS b FROM links WHERE \"in\" <> out UNION SELECT out, \"in\" FROM links WHERE \"in\" <> out)"
_PATH = f"""
WITH RECURSIVE {_BOTH},
w AS (SELECT 'note:2_0' AS id, 0 AS d UNION SELECT e.b, w.d + 1 FROM w JOIN e ON e.a = w.id WHERE w.d < 8),
t AS MATERIALIZED (SELECT id, min(d) AS d FROM w GROUP BY id),
p AS (SELECT 0 AS step, 'note:1_0' AS id UNION ALL SELECT p.step + 1, min(e.b) FROM p JOIN e ON e.a = p.id JOIN t AS x ON x.id = p.id JOIN t AS y ON y.id = e.b AND y.d = x.d - 1 GROUP BY p.step)
SELECT step, id FROM p
"""


@query("shortest_path_between_notes", _PATH, "links")
def path(c):
    return graph.shortest_path(c.links(), "note:1_0", "note:2_0")


def _labels_sql(rounds: int) -> str:
    steps = ["l0 AS MATERIALIZED (SELECT DISTINCT a AS id, a AS label FROM e)"]
    for i in range(2 * rounds):
        heard = f"SELECT e.a AS id, l.label, count(*) AS n FROM e JOIN l{i} AS l ON l.id = e.b GROUP BY ALL"
        best = f"SELECT h.id, min((-h.n, h.label <> o.label, h.label)) AS best FROM ({heard}) AS h JOIN l{i} AS o ON o.id = h.id WHERE ('0x' || left(md5(h.id), 1))::INT % 2 = {i % 2} GROUP BY h.id"
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT l.id, coalesce(b.best[3], l.label) AS label FROM l{i} AS l LEFT JOIN ({best}) AS b USING (id))")
    return f"WITH {_BOTH}, {', '.join(steps)} SELECT id, label FROM l{2 * rounds}"


@query("communities_by_labels", _labels_sql(3), "links")
def communities(c):
    return graph.label_propagation(c.links(), rounds=3)


_MODULARITY = f"""
WITH {_BOTH}, m AS (SELECT count(*) AS m FROM e), n AS (SELECT a AS id, split_part(a, ':', 1) AS label FROM e GROUP BY a),
g AS (SELECT x.label, count(*) AS ends, count(*) FILTER (WHERE x.label = y.label) AS inside FROM e JOIN n AS x ON x.id = e.a JOIN n AS y ON y.id = e.b GROUP BY x.label)
SELECT round(sum(inside / m - (ends / m) ** 2), 9) AS modularity, count(*) AS communities FROM g, m
"""


@query("modularity_of_kinds", _MODULARITY, "links")
def kinds(c):
    """How far links stay within one kind of record."""
    ids = graph.both_ways(c.links()).select(F.col("in").alias("id")).distinct()
    return graph.modularity(c.links(), ids.withColumn("label", F.substring_index("id", ":", 1))).select(F.round("modularity", 9).alias("modularity"), "communities")


def _push_sql(rounds: int, error: float) -> str:
    steps = ["k AS MATERIALIZED (SELECT a AS id, count(*) AS k FROM e GROUP BY a)", "s0 AS (SELECT id AS seed, id, k, 0.0::DOUBLE AS rank, 1.0::DOUBLE AS residual FROM k WHERE id IN ('source:3', 'topic:en'))"]
    for i in range(rounds):
        due = f"residual > {error}::DOUBLE * k"
        own = f"SELECT seed, id, k, rank + CASE WHEN {due} THEN 0.15::DOUBLE * residual ELSE 0 END AS rank, CASE WHEN {due} THEN 0 ELSE residual END AS residual FROM s{i}"
        given = f"SELECT s.seed, e.b AS id, k.k, 0.0::DOUBLE, 0.85::DOUBLE * s.residual / s.k FROM s{i} AS s JOIN e ON e.a = s.id JOIN k ON k.id = e.b WHERE s.residual > {error}::DOUBLE * s.k"
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT seed, id, max(k) AS k, sum(rank) AS rank, sum(residual) AS residual FROM ({own} UNION ALL {given}) GROUP BY seed, id)")
    return f"WITH {_BOTH}, {', '.join(steps)} SELECT seed, id, round(rank, 9) AS rank FROM s{rounds} WHERE rank > 0"


@query("ranks_from_seeds", _push_sql(4, 1e-5), "links")
def seeds(c):
    """Four rounds of forward push from two stated seeds."""
    start = c.links().where(F.col("in") == "source:3").select(F.col("in").alias("id")).unionAll(c.links().where("out = 'topic:en'").select(F.col("out").alias("id")))
    return graph.personalised_page_rank(c.links(), start, error=1e-5, rounds=4).select("seed", "id", F.round("rank", 9).alias("rank"))


_HARMONIC = f"""
WITH RECURSIVE {_BOTH}, w AS (SELECT DISTINCT a AS start, a AS id, 0 AS d FROM e WHERE a LIKE 'topic:%' UNION SELECT w.start, e.b, w.d + 1 FROM w JOIN e ON e.a = w.id WHERE w.d < 4),
t AS (SELECT start, id, min(d) AS d FROM w GROUP BY ALL)
SELECT start AS id, count(*) AS reached, round(sum(1 / d), 6) AS harmonic FROM t WHERE d > 0 GROUP BY start
"""


@query("harmonic_centrality_of_topics", _HARMONIC, "links")
def topics(c):
    """Exact, for the few topics, to four links away."""
    starts = c.links().where("out LIKE 'topic:%'").select(F.col("out").alias("id")).distinct()
    return graph.harmonic_exact(c.links(), starts, 4).select("id", "reached", F.round("harmonic", 6).alias("harmonic"))


@query("harmonic_centrality_estimates")
def estimates(c):
    """Of all nodes, by sketches."""
    return graph.harmonic_centrality(c.links()).select("id", F.round("reached", 3).alias("reached"), F.round("harmonic", 3).alias("harmonic"))
