"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import remove, written


#: Edges in a file of the rounds' tables: few edges go to few files and tasks, many stay where the shuffle has them.
EDGES_A_FILE = 500_000


def _lowest(links: DataFrame, parts: int) -> DataFrame:
    # Written, so that the joins below are of two plain tables: Spark can then split a hub's edges over tasks.
    return written(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(parts), "lowest")


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both, parts)
    out = written(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(parts), "edges")
    remove(low)
    return out


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _lowest(down, parts)
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(linked.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct().coalesce(parts), "edges")
    remove(low, edges)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that has an edge in (u, v) and is not the least of its component, with the least node.

    The rounds grow with the logarithm of the longest path and end when all edges
    lead to the least node of a star; each ends in written tables, which replace
    those of the round before. The joins are on one node's edges and the node's
    minimum, one row for each node.
    """
    edges = written(edges.select("u", "v").where("u <> v"), "edges")
    parts = max(1, -(-edges.count() // EDGES_A_FILE))
    edges = _small_star(edges, parts)
    while _paths(edges, parts):
        large = _large_star(edges, parts)
        remove(edges)
        edges = _small_star(large, parts)
    return edges


def _paths(edges: DataFrame, parts: int) -> bool:
    """Whether some node has two edges that lead down, or edges both up and down. Without any, the edges are stars."""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    sums = roles.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).coalesce(parts)
    return sums.where("down > 1 OR down = 1 AND up = 1").limit(1).count() > 0
