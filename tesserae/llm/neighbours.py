"""Operator 1: nearest neighbours by inner product, with vantage-point trees per shard.

The largest inner product becomes the smallest distance by one more coordinate:
x goes to (x, sqrt(M^2 - |x|^2)) with M the largest norm, a query to (q, 0), and
the distance squared is |q|^2 + M^2 - 2 <q, x>. Each shard of candidates builds a
tree: a node's vantage point splits its points at the median distance and keeps
the range of distances on either side. By the triangle inequality a side whose
range is at least ``b`` away from the query's own distance holds nothing nearer
than ``b``; it is left out when ``factor * b`` is beyond the worst neighbour kept.
With ``factor=1`` the search is exact; a larger factor visits less.

Queries are a stated set. Their blocks, of up to QUERY_ROWS, go to groups of up to
GROUP_SHARDS shards, each pair a task of its own, which makes the trees of its group
and in which the neighbours kept from one shard bound the search of the next. So
a vector is sent once for each block of queries, a query once for each group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import cut, partitions, small_batches

SHARD_ROWS, QUERY_ROWS, GROUP_SHARDS, LEAF = 4096, 16_384, 8, 48
#: Products that differ by less than this share of the largest possible one are taken as equal where the nearest are kept:
#: the order of summing alone makes such differences.
SLACK = 1e-12


@dataclass
class Node:
    """A vantage point (at ``first`` in the shard's order), its sides, and ranges that hold their distances; or a leaf."""

    first: int
    after: int
    inner: tuple[float, float] = (0.0, 0.0)
    outer: tuple[float, float] = (0.0, 0.0)
    sides: tuple[Node, Node] | None = None


class Shard:
    """Distinct vectors of a shard in tree order, with the ids of each (the least ``keep``, which is all a search can return)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: float, keep: int):
        order = np.lexsort([ids])
        ids, vectors = ids[order], vectors[order]
        x, inverse = np.unique(vectors, axis=0, return_inverse=True)
        by = np.argsort(inverse.ravel(), kind="stable")
        starts = np.searchsorted(inverse.ravel()[by], np.arange(len(x)))
        self.ids = [ids[by[a:b]][:keep] for a, b in zip(starts, [*starts[1:], len(by)], strict=True)]
        lifted = np.concatenate([x, np.sqrt(np.maximum(bound**2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)
        self.order = np.arange(len(x))
        self.root = self._build(lifted, 0, len(x), np.random.default_rng(len(x)))
        self.vectors = x[self.order]
        self.ids = [self.ids[i] for i in self.order]
        self.least = np.array([i[0] for i in self.ids], np.int64)

    def _build(self, x: np.ndarray, a: int, b: int, r: np.random.Generator) -> Node:
        if b - a <= LEAF:
            return Node(a, b)
        # The vantage point: the farthest from a random one, which lies at an edge and splits well.
        own = self.order[a:b]
        at = int(np.argmax(((x[own] - x[own[r.integers(b - a)]]) ** 2).sum(axis=1)))
        own[[0, at]] = own[[at, 0]]
        d = np.sqrt(((x[own[1:]] - x[own[0]]) ** 2).sum(axis=1))
        by = np.argsort(d, kind="stable")
        own[1:] = own[1:][by]
        d, half = d[by], len(by) // 2
        return Node(a, b, (float(d[0]), float(d[half])), (float(d[half - 1]), float(d[-1])), (self._build(x, a + 1, a + 1 + half, r), self._build(x, a + 1 + half, b, r)))


class Search:
    """The best k distinct vectors so far of each query of a block; of equal products those of the least ids."""

    def __init__(self, queries: np.ndarray, bound: float, k: int, factor: float):
        self.q, self.k, self.factor = queries, k, factor
        self.base = (queries * queries).sum(axis=1) + bound**2
        self.unit = np.maximum(np.sqrt((queries * queries).sum(axis=1)) * bound, 1e-300) * SLACK
        self.best = np.full((len(queries), k), -np.inf)  # products, the largest first: the last is the worst kept
        self.named = np.full((len(queries), k), np.iinfo(np.int64).max)  # their least ids
        self.found = np.full((len(queries), k), -1, np.int64)
        self.worst = np.full(len(queries), np.inf)  # distance of the worst kept

    def _keep(self, q: np.ndarray, products: np.ndarray, places: np.ndarray, least: np.ndarray) -> None:
        better = (products >= (self.best[q, -1] - self.unit[q])[:, None]).any(axis=1)
        q, products = q[better], products[better]
        if not len(q):
            return
        both = np.concatenate([self.best[q], products], axis=1)
        names = np.concatenate([self.named[q], np.broadcast_to(least, products.shape)], axis=1)
        found = np.concatenate([self.found[q], np.broadcast_to(places, products.shape)], axis=1)
        by = np.lexsort((names, -np.round(both / self.unit[q][:, None])), axis=1)[:, : self.k]
        for kept, new in ((self.best, both), (self.named, names), (self.found, found)):
            kept[q] = np.take_along_axis(new, by, axis=1)
        self.worst[q] = self._distance(q, self.best[q, -1]) * (1 + 1e-9) + 1e-12

    def _distance(self, q: np.ndarray, product: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.base[q] - 2 * np.maximum(product, -1e300), 0))

    def _leaf(self, shard: Shard, node: Node, q: np.ndarray, offset: int) -> None:
        own = slice(node.first, node.after)
        self._keep(q, self.q[q] @ shard.vectors[own].T, np.arange(node.first, node.after) + offset, shard.least[own])

    def visit(self, shard: Shard, offset: int) -> None:
        """Searches a shard whose places are numbered from ``offset`` on.

        Each query first goes down the nearer sides to one leaf, for a first bound.
        Then the tree is gone through once for all queries together, each leaving
        out the sides that its bound rules out.
        """
        home = np.full(len(self.q), -1)
        stack = [(shard.root, np.arange(len(self.q)))]
        while stack:
            node, q = stack.pop()
            if node.sides is None:
                home[q] = node.first
                self._leaf(shard, node, q, offset)
                continue
            d = self._distance(q, self.q[q] @ shard.vectors[node.first])
            inner = d - node.inner[1] <= node.outer[0] - d
            stack += [(side, part) for side, part in zip(node.sides, (q[inner], q[~inner]), strict=True) if len(part)]
        stack = [(shard.root, np.arange(len(self.q)))]
        while stack:
            node, q = stack.pop()
            if node.sides is None:
                if len(q := q[home[q] != node.first]):
                    self._leaf(shard, node, q, offset)
                continue
            product = self.q[q] @ shard.vectors[node.first]
            self._keep(q, product[:, None], np.array([node.first + offset]), shard.least[[node.first]])
            d = self._distance(q, product)
            for side, (lo, hi) in zip(node.sides, (node.inner, node.outer), strict=True):
                part = q[self.factor * np.maximum(lo - d, d - hi) <= self.worst[q]]
                if len(part):
                    stack.append((side, part))


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column, *, k: int = 20, factor: float = 1.2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest candidates found of each query, nearest first, ties to the lesser id.

    ``queries`` is a predicate on the table; candidates are all rows but those of
    the query's own id. ``score`` is the inner product in double precision. Vectors
    that are null, empty, zero or hold null or non-finite components take no part,
    nor do null ids; vectors are compared with those of their own width. Repeated
    rows are candidates each; a query has all candidates if they are fewer than
    ``k``, and none (no row) in an empty table. factor 1 is exact.
    """
    small_batches(vectors.sparkSession)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.select("id", "v", "is_query", F.size("v").alias("width"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    # Few widths: one row for each, with the bound of its norms.
    widths = rows.groupBy("width").agg(F.max(norm).alias("bound"), F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("m"))
    widths = cut(widths.select("width", (F.col("bound") * (1 + 1e-12)).alias("bound"), F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"), F.ceil(F.col("m") / QUERY_ROWS).cast("int").alias("blocks")).where("blocks > 0"))
    rows = rows.join(F.broadcast(widths), "width")
    cores = partitions(vectors.sparkSession)
    group_shards = F.greatest(F.lit(1), F.least(F.lit(GROUP_SHARDS), F.floor(F.col("shards") / cores))).cast("int")

    def matrix(table: pa.Table) -> np.ndarray:
        v = table["v"].combine_chunks()
        return np.asarray(v.flatten(), float).reshape(len(v), -1)

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int")).withColumn("grp", (F.col("shard") / group_shards).cast("int"))
    dealt = dealt.select("width", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "shard", "id", "v", "bound")
    asked = rows.where("is_query").withColumn("block", F.pmod(F.xxhash64("v", "id"), F.col("blocks")).cast("int"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), ((F.col("shards") - 1) / group_shards).cast("int"))).alias("grp"), *(F.col(x).alias(x) for x in ("width", "block", "id", "v")))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if right.num_rows and left.num_rows:
            ids, q, bound = right["id"].to_numpy(), matrix(right), left["bound"][0].as_py()
            state, offset, shards = Search(q, bound, k + 1, factor), 0, []
            x, names, shard = matrix(left), left["id"].to_numpy(), left["shard"].to_numpy()
            for i in np.unique(shard):
                shards.append(Shard(names[shard == i], x[shard == i], bound, k + 1))
                state.visit(shards[-1], offset)
                offset += len(shards[-1].ids)
            x, names = np.concatenate([s.vectors for s in shards]), [n for s in shards for n in s.ids]
            for i in range(len(ids)):
                own = state.found[i][state.found[i] >= 0]
                # Summed in one way for all, so that equal vectors have equal scores.
                score = (q[i] * x[own]).sum(axis=1)
                pairs = sorted((-s, int(n)) for s, p in zip(score.tolist(), own.tolist(), strict=True) for n in names[p] if n != ids[i])[:k]
                out[0].extend([int(ids[i])] * len(pairs))
                out[1].extend(n for _, n in pairs)
                out[2].extend(-s for s, _ in pairs)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = dealt.groupBy("width", "grp", "block").cogroup(asked.groupBy("width", "grp", "block")).applyInArrow(search, "query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
