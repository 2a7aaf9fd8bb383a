import random
from collections import Counter, deque
from hashlib import md5

import numpy as np
import pytest

from tesserae.operators import graph


def some_graph(seed, nodes=60, edges=75):
    r = random.Random(seed)
    hub = [("hub", f"n{i:02d}") for i in range(0, nodes, 9)]
    return [(f"n{r.randrange(nodes):02d}", f"n{r.randrange(nodes):02d}") for _ in range(edges)] + hub + hub[:3] + [("far1", "far2")]


def neighbours(rows):
    out = {}
    for a, b in rows:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def distances(near, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                queue.append(y)
    return seen


@pytest.fixture(scope="module")
def rows():
    return some_graph(7)


@pytest.fixture(scope="module")
def edges(spark, rows):
    return spark.createDataFrame(rows, "in string, out string")


def test_shortest_path_is_the_least_one(edges, rows):
    near = neighbours(rows)
    r = random.Random(1)
    names = sorted(near)
    for start, target in [(names[3], names[3]), ("far1", "far2"), ("far1", names[0]), ("nobody", names[0]), *((r.choice(names), r.choice(names)) for _ in range(4))]:
        got = [x.id for x in graph.shortest_path(edges, start, target).orderBy("step").collect()]
        to = distances(near, target) if target in near else {}
        want = []
        if start in to:
            want = [start]
            while want[-1] != target:
                want.append(min(y for y in near[want[-1]] if to[y] == to[want[-1]] - 1))
        assert got == want
        if len(want) > 3:
            assert graph.shortest_path(edges, start, target, longest=2).count() == 0


def test_hops_and_exact_centrality(spark, edges, rows):
    near = neighbours(rows)
    starts = spark.createDataFrame([("hub",), ("far1",), ("nobody",)], "id string")
    got = {(x.start, x.id): x.hop for x in graph.hops(graph.both_ways(edges), starts, 5).collect()}
    want = {(s, x): d for s in ("hub", "far1") for x, d in distances(near, s).items() if d <= 5} | {("nobody", "nobody"): 0}
    assert got == want
    exact = {x.id: x.harmonic for x in graph.harmonic_exact(edges, starts.limit(2)).collect()}
    assert exact["hub"] == pytest.approx(sum(1 / d for d in distances(near, "hub").values() if d))


def test_walks(spark, edges, rows):
    plain = set(rows)
    count = Counter(a for a, b in plain for c, _ in plain if c == b)
    names = spark.createDataFrame([(x,) for x in {a for e in rows for a in e}], "id string")
    assert {x.id: x.walks for x in graph.walk_counts(edges, names, 2).collect()} == {x: count.get(x, 0) for x in {a for e in rows for a in e}}


@pytest.mark.parametrize("rounds", [1, 4])
def test_labels_against_rounds_in_a_loop(edges, rows, rounds):
    near = neighbours(rows)
    labels = {x: x for x in near}
    for _ in range(rounds):
        for turn in (0, 1):
            new = dict(labels)
            for x in near:
                if int(md5(x.encode()).hexdigest()[0], 16) % 2 == turn:
                    n = Counter(labels[y] for y in near[x])
                    new[x] = min(n, key=lambda label: (-n[label], label != labels[x], label))
            labels = new
    found = graph.label_propagation(edges, rounds)
    assert {x.id: x.label for x in found.collect()} == labels
    m = sum(len(y) for y in near.values())
    want = sum(sum(labels[y] == c for x in near if labels[x] == c for y in near[x]) / m - (sum(len(near[x]) for x in near if labels[x] == c) / m) ** 2 for c in set(labels.values()))
    got = graph.modularity(edges, found).first()
    assert got.modularity == pytest.approx(want) and got.communities == len(set(labels.values()))


def test_pushed_ranks_are_within_their_bound(spark, edges, rows):
    near = neighbours(rows)
    names = sorted(near)
    at = {x: i for i, x in enumerate(names)}
    walk = np.zeros((len(names), len(names)))
    for x in names:
        for y in near[x]:
            walk[at[y], at[x]] = 1 / len(near[x])
    seeds = ["hub", "far1", names[5]]
    got = graph.personalised_page_rank(edges, spark.createDataFrame([(s,) for s in [*seeds, "nobody", "hub"]], "id string"), error=1e-5).collect()
    assert {x.seed for x in got} == set(seeds)
    for seed in seeds:
        exact = np.linalg.solve(np.eye(len(names)) - 0.85 * walk, 0.15 * np.eye(len(names))[at[seed]])
        own = {x.id: x for x in got if x.seed == seed}
        left = next(iter(own.values())).left
        assert left <= 1e-5 * sum(map(len, near.values()))
        assert all(-1e-12 <= exact[at[x]] - (own[x].rank if x in own else 0) <= left + 1e-12 for x in names)


def test_centrality_estimates(spark):
    rows = [(f"c{i % 20}", f"v{i}") for i in range(1500)] + [(f"c{i}", f"c{i + 1}") for i in range(19)]
    near = neighbours(rows)
    got = {x.id: x for x in graph.harmonic_centrality(spark.createDataFrame(rows, "in string, out string"), furthest=32).collect()}
    for x in ("c0", "c10", "v7"):
        exact = distances(near, x)
        assert got[x].reached == pytest.approx(len(exact) - 1, rel=0.06)
        assert got[x].harmonic == pytest.approx(sum(1 / d for d in exact.values() if d), rel=0.06)


def test_sketches_are_made_once_a_class_and_never_broadcast(spark, monkeypatch):
    plans, kept = [], graph.stored

    def noted(df, name, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = kept(df, name, *more)
        if name == "sketches":
            sizes.append(out.count())
        return out

    sizes = []
    monkeypatch.setattr(graph, "stored", noted)
    rows = [(f"v{i}", f"hub{i % 3}") for i in range(900)]
    assert graph.harmonic_centrality(spark.createDataFrame(rows, "in string, out string")).count() == 903
    assert not any("BroadcastHashJoin" in p and "sketch" in p for p in plans)
    # Of 903 nodes, those of a hub are one class after the first round.
    assert sizes[0] == 903 and max(sizes[3:]) <= 6


def test_two_hops_lose_no_pair(spark):
    rows = [("a", "x"), ("b", "x"), ("a", "x"), ("c", "x"), ("c", "y"), ("d", "z"), ("x", "n1"), ("x", "n2"), ("y", "n2"), ("y", "n3")]
    got = graph.two_hops(spark.createDataFrame(rows, "in string, out string"), spark.createDataFrame([(x,) for x in "abcde"], "id string")).collect()
    of = {r.start: r["class"] for r in got if r.id is None}
    assert of == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"} and {r.start: r.walks for r in got if r.id is None} == {"a": 2, "b": 2, "c": 4, "d": 0, "e": 0}
    pairs = {(s, r.id) for s in of for r in got if r.id is not None and r.start == of[s]}
    assert pairs == {(a, d) for a, b in rows for c, d in rows if b == c and a in of}


def test_graphs_of_nothing(spark):
    none = spark.createDataFrame([], "in string, out string")
    nodes = spark.createDataFrame([], "id string")
    assert graph.label_propagation(none).count() == graph.harmonic_centrality(none).count() == graph.personalised_page_rank(none, nodes).count() == graph.hops(none, nodes, 3).count() == 0
    assert graph.shortest_path(none, "a", "b").count() == 0
