"""Edge tables (in, out): traversal, degrees, and iterative graph measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.lineage import discard, shared_folder, stored


def outgoing(edges: DataFrame, start: str, rows: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows that edges from ``start`` lead to; a duplicate edge gives its row again."""
    return edges.where(F.col("in") == start).select(F.col("out").alias("id")).join(rows.drop(*drop), "id")


def incoming(edges: DataFrame, target: str, rows: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows with an edge to ``target``; a duplicate edge gives its row again."""
    return edges.where(F.col("out") == target).select(F.col("in").alias("id")).join(rows.drop(*drop), "id")


def degrees(rows: DataFrame, **edges: DataFrame) -> DataFrame:
    """Rows with one count for each named edge table: edges that lead to the row, 0 if none."""
    for name, e in edges.items():
        rows = rows.join(e.groupBy(F.col("out").alias("id")).agg(F.count("*").alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once; no loops, no nulls."""
    e = edges.select("in", "out").where("`in` <> `out`")
    return e.unionAll(e.select(F.col("out").alias("in"), F.col("in").alias("out"))).distinct()


def hops(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """(start, id, hop): what is reached from each start, with the least number of hops, up to ``k``. A row for each pair, so the
    starts should be few; each round reads the tables of the round before."""
    seen = stored(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop")).distinct(), "hops")
    step = stored(edges.select(F.col("in").alias("id"), F.col("out").alias("next")).distinct(), "steps")
    front, found = seen, seen
    for h in range(1, k + 1):
        front = stored(front.join(step, "id").select("start", F.col("next").alias("id"), F.lit(h).alias("hop")).distinct().join(found.select("start", "id"), ["start", "id"], "left_anti"), "hops")
        found = found.unionByName(front)
    return found


def walk_counts(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """(id, walks): walks of exactly ``k`` different edges' steps from each start. Counts are summed node by node from the walks' ends, so no
    pair of start and end is ever a row."""
    e = edges.select("in", "out").distinct()
    ends = None
    for _ in range(k):
        step = e if ends is None else e.join(ends, e["out"] == ends["id"])
        ends = step.groupBy(F.col("in").alias("id")).agg((F.count("*") if ends is None else F.sum("walks")).alias("walks"))
        ends = stored(ends, "walks") if k > 2 else ends
    return starts.select("id").join(ends, "id", "left").select("id", F.coalesce("walks", F.lit(0)).alias("walks"))


def two_hops(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, class, id, walks): all that two different edges' steps lead to from each start, as classes. Starts with the same
    edges are a class, named by the least of them. A start's own row has no id and counts all of its walks; the class has
    a row for each node that it reaches. So a start's pairs are its class's, and equal starts are not paired with the same nodes again."""
    e = edges.select("in", "out").distinct()
    by = [f"_d{i}" for i in range(4)]
    sums = starts.select("id").distinct().join(e.withColumnRenamed("in", "id"), "id", "left").groupBy("id").agg(*_digest("out"))
    known = stored(sums.select("id", *(F.coalesce(x, F.lit(0)).alias(x) for x in by)), "starts")
    of = stored(known.join(known.groupBy(*by).agg(F.min("id").alias("class")), by).select("id", "class"), "classes")
    first = of.where("id = class").join(e.withColumnRenamed("in", "class"), "class").select("class", F.col("out").alias("via"))
    reached = first.join(e.select(F.col("in").alias("via"), F.col("out").alias("id")), "via").groupBy("class", "id").agg(F.count("*").alias("walks"))
    walks = walk_counts(edges, of, 2).join(of, "id")
    return walks.select(F.col("id").alias("start"), "class", F.lit(None).cast("string").alias("id"), "walks").unionByName(reached.select(F.col("class").alias("start"), "class", "id", "walks"))


def _front(front: DataFrame, step: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """What is next to ``front`` and in no layer so far."""
    near = front.join(step, "id").select(F.col("next").alias("id")).distinct()
    for layer in seen[-2:]:  # an edge leads one layer forth or back, or stays
        near = near.join(layer, "id", "left_anti")
    return stored(near, "layer")


def shortest_path(edges: DataFrame, start: str, target: str, longest: int = 64) -> DataFrame:
    """(step, id): of the shortest paths over edges in either direction the least one, node by node in the order of ids; no row if
    there is none of up to ``longest`` edges.

    The search goes from both ends by layers of nodes, each a table, always from the end with fewer nodes in its layer. Where
    the layers meet, those nodes that lie on a shortest path are traced back, layer by layer; the driver sees one node a step.
    """
    spark = edges.sparkSession
    step = stored(both_ways(edges).select(F.col("in").alias("id"), F.col("out").alias("next")), "steps")
    known = lambda x: step.where(F.col("id") == x).select("id").limit(1)
    layers, sizes = [[stored(known(start), "layer")], [stored(known(target), "layer")]], [1, 1]
    none = spark.createDataFrame([], "step int, id string")
    if not all(side[0].count() for side in layers):
        return none
    if start == target:
        return spark.createDataFrame([(0, start)], "step int, id string")
    meet = None
    while sum(map(len, layers)) - 2 < longest:
        side = 0 if sizes[0] <= sizes[1] else 1
        layers[side].append(_front(layers[side][-1], step, layers[side]))
        sizes[side] = layers[side][-1].count()
        if not sizes[side]:
            return none
        meet = layers[0][-1].join(layers[1][-1], "id", "left_semi")
        if meet.limit(1).count():
            break
    else:
        return none
    # The nodes of each layer that are on a shortest path, from the meeting ones to both ends.
    on = [stored(meet, "on")]
    for layer in reversed(layers[0][:-1]):
        on.insert(0, stored(layer.join(on[0].join(step, "id").select(F.col("next").alias("id")).distinct(), "id", "left_semi"), "on"))
    for layer in reversed(layers[1][:-1]):
        on.append(stored(layer.join(on[-1].join(step, "id").select(F.col("next").alias("id")).distinct(), "id", "left_semi"), "on"))
    path = [start]
    for layer in on[1:]:
        near = step.where(F.col("id") == path[-1]).select(F.col("next").alias("id"))
        path.append(layer.join(near, "id", "left_semi").agg(F.min("id").alias("id")).first()["id"])
    return spark.createDataFrame(list(enumerate(path)), "step int, id string")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): communities, by the label that most neighbours have; of equally frequent ones the own label, else the least.

    In each round one half of the nodes (by the first digit of the md5 of the id) and then the other takes its neighbours'
    labels, so that two sides of the graph don't swap labels for ever. It ends when no label changes, or after ``rounds``.
    """
    e = stored(both_ways(edges), "edges")
    labels = stored(e.select(F.col("in").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    half = (F.conv(F.substring(F.md5(F.col("id").cast("binary")), 1, 1), 16, 10).cast("int") % 2)
    for _ in range(rounds):
        changed = 0
        for turn in (0, 1):
            heard = e.join(labels.select(F.col("id").alias("out"), "label"), "out").groupBy(F.col("in").alias("id"), "label").agg(F.count("*").alias("n"))
            own = labels.select("id", F.col("label").alias("own")).where(half == turn)
            best = heard.join(own, "id").groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), (F.col("label") != F.col("own")).cast("int").alias("other"), "label")).alias("best")).select("id", F.col("best.label").alias("new"))
            after = stored(labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") != F.col("label")).alias("moved")), "labels")
            changed += after.where("moved").limit(1).count()
            labels = after.drop("moved")
        if not changed:
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (modularity, communities) of a division of the nodes: the share of edges within communities, less what chance would give."""
    e = both_ways(edges)
    of = e.join(labels.select(F.col("id").alias("in"), F.col("label").alias("a")), "in").join(labels.select(F.col("id").alias("out"), F.col("label").alias("b")), "out")
    each = of.groupBy(F.col("a").alias("label")).agg(F.count("*").alias("ends"), F.count_if(F.col("a") == F.col("b")).alias("inside"))
    total = each.agg(F.sum("ends").alias("m"))
    return each.join(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("ends") / F.col("m"), 2)), F.lit(0.0)).alias("modularity"), F.count("*").alias("communities"))


def personalised_page_rank(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, error: float = 1e-4, rounds: int = 200) -> DataFrame:
    """(seed, id, rank, left): ranks of walks that go back to their seed, for all seeds (id) at once, by forward push.

    A node holds for each seed its rank so far and a residual that is still to be spread. While a residual is above ``error``
    times the node's edges, the node keeps 1 - ``damping`` of it and gives its neighbours the rest. Only what is reached with
    weight is ever a row: at most 1 / (``error`` * (1 - ``damping``)) edges' ends for each seed. ``left`` is what the seed has not spread;
    each rank is at most that much below the exact one, and never above it. Edges count in both directions.
    """
    e = stored(both_ways(edges), "edges")
    degree = stored(e.groupBy(F.col("in").alias("id")).agg(F.count("*").alias("k")), "degrees")
    start = seeds.select("id").distinct().join(degree, "id").select(F.col("id").alias("seed"), "id", "k", F.lit(0.0).alias("rank"), F.lit(1.0).alias("residual"))
    state = stored(start, "push")
    for _ in range(rounds):
        due = state.where(F.col("residual") > error * F.col("k"))
        if not due.limit(1).count():
            break
        kept = F.col("residual") > error * F.col("k")
        given = due.join(e.withColumnRenamed("in", "id"), "id").groupBy("seed", F.col("out").alias("id")).agg(F.sum(damping * F.col("residual") / F.col("k")).alias("got"))
        own = state.select("seed", "id", "k", (F.col("rank") + F.when(kept, (1 - damping) * F.col("residual")).otherwise(0.0)).alias("rank"), F.when(kept, 0.0).otherwise(F.col("residual")).alias("residual"))
        spread = given.join(degree, "id").select("seed", "id", "k", F.lit(0.0).alias("rank"), F.col("got").alias("residual"))
        after = stored(own.unionByName(spread).groupBy("seed", "id").agg(F.max("k").alias("k"), F.sum("rank").alias("rank"), F.sum("residual").alias("residual")), "push")
        discard(state)
        state = after
    left = state.groupBy("seed").agg(F.sum("residual").alias("left"))
    return state.where("rank > 0").join(left, "seed").select("seed", "id", "rank", "left")


def _digest(key: str) -> list[Column]:
    """Sums that tell multisets of keys apart: two hashes of 64 bits, each in halves, so sums of 2^31 keys fit."""
    hashes = [F.xxhash64(F.col(key)), F.xxhash64(F.lit(1), F.col(key))]
    halves = [x for h in hashes for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return [F.sum(x).alias(f"_d{i}") for i, x in enumerate(halves)]


def harmonic_centrality(edges: DataFrame, *, furthest: int = 16, bits: int = 12) -> DataFrame:
    """(id, reached, harmonic): about how many nodes a node reaches, and the sum of 1 / distance over them.

    Each node has a HyperLogLog sketch of 2^``bits`` registers of what it reaches; a round unites those of its neighbours, and
    what the estimate grows by is at that distance. The sketches have one size however many nodes they stand for, with a relative
    error of about 1.04 / 2^(bits / 2). It ends when no estimate grows, or at ``furthest``. Edges count in both directions.

    Nodes hold their sketch's key. Those whose neighbours have the same sketches are a class, for which the next one is made
    once, at its least node. Sketches take far less room in files than in memory, so the joins state that they sort: Spark
    would take the tables for small and broadcast them through the driver.
    """
    e = stored(both_ways(edges).select(F.col("in").alias("id"), F.col("out").alias("near")), "edges")
    nodes = stored(e.select("id").distinct(), "nodes")
    sketches = stored(nodes.groupBy("id").agg(F.hll_sketch_agg("id", bits).alias("sketch")).select(F.md5("id").alias("key"), "sketch"), "sketches")
    state = stored(nodes.select("id", F.md5("id").alias("key"), F.lit(1.0).alias("reached"), F.lit(0.0).alias("harmonic"), F.lit(True).alias("grew")), "states")
    by = [f"_d{i}" for i in range(4)]
    for distance in range(1, furthest + 1):
        # After the first round a node's own sketch is part of its neighbours'.
        step = e.unionByName(nodes.withColumn("near", F.col("id"))) if distance == 1 else e
        heard = stored(step.join(state.select(F.col("id").alias("near"), "key").hint("merge"), "near").select("id", "key"), "heard")
        of = stored(heard.groupBy("id").agg(*_digest("key")), "classes")
        least = of.groupBy(*by).agg(F.min("id").alias("id"))
        united = heard.join(least.hint("merge"), "id").select(*by, "key").distinct().join(sketches.hint("merge"), "key").groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))
        made = stored(united.withColumns({"key": F.md5("sketch"), "estimate": F.hll_sketch_estimate("sketch").cast("double")}), "sketches")
        estimate = F.greatest("estimate", "reached")
        new = state.drop("key", "grew").join(of.hint("merge"), "id").join(made.drop("sketch").hint("merge"), by)
        after = stored(new.select("id", "key", estimate.alias("reached"), (F.col("harmonic") + (estimate - F.col("reached")) / distance).alias("harmonic"), (estimate > F.col("reached")).alias("grew")), "states")
        once = stored(made.groupBy("key").agg(F.first("sketch").alias("sketch")), "sketches")
        discard(state, heard, of, made, sketches)
        state, sketches = after, once
        if not state.where("grew").limit(1).count():
            break
    return state.select("id", (F.col("reached") - 1).alias("reached"), "harmonic")


def harmonic_exact(edges: DataFrame, starts: DataFrame, furthest: int = 16) -> DataFrame:
    """(id, reached, harmonic) of these nodes exactly: a row for each start and node that it reaches."""
    found = hops(both_ways(edges), starts, furthest).where("hop > 0")
    return found.groupBy(F.col("start").alias("id")).agg(F.count("*").alias("reached"), F.sum(1 / F.col("hop")).alias("harmonic"))


def co_linked(edges: DataFrame, item: str, n: int) -> DataFrame:
    """(id, shared): other ins that share outs with ``item``, most first, ties by id."""
    e = edges.select("in", "out").distinct()
    mine = e.where(F.col("in") == item).select("out")
    return e.join(mine, "out").where(F.col("in") != item).groupBy(F.col("in").alias("id")).agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "id").limit(n)


def page_rank(edges: DataFrame, *, damping: float = 0.85, rounds: int = 10, cut=None) -> DataFrame:
    """(id, rank): ranks sum to one; nodes without outgoing edges spread theirs evenly. ``cut`` ends the lineage after each round, by default with a checkpoint."""
    shared_folder(edges.sparkSession)
    cut = cut or (lambda df: df.checkpoint())
    e = cut(edges.select("in", "out").distinct())
    k = e.groupBy(F.col("in").alias("id")).agg(F.count("*").alias("k"))
    nodes = cut(e.select(F.col("in").alias("id")).union(e.select("out")).distinct().join(k, "id", "left"))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        # One number, of the nodes without outgoing edges.
        loose = ranks.where("k IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = e.join(ranks.where("k IS NOT NULL"), F.col("in") == F.col("id")).groupBy(F.col("out").alias("id")).agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
        ranks = cut(nodes.join(sent, "id", "left").select("id", "k", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("rank")))
    return ranks.drop("k")


def unlink(edges: DataFrame, start: str, target: str) -> DataFrame:
    """The edges without those between these two."""
    return edges.where(~((F.col("in") == start) & (F.col("out") == target)))


def linked_both(edges: DataFrame, start: Column, target: Column) -> DataFrame:
    """Edges by both of their ends."""
    return edges.where((F.col("in") == start) & (F.col("out") == target))
