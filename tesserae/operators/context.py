"""Context assembly: keep-first deduplication, priorities and a token budget, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.running import running_sums

#: Priorities of item kinds.
PRIORITY = {"source": 100, "insight": 75, "note": 50}


def keep_first(items: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prioritised(items: DataFrame) -> DataFrame:
    return items.withColumn("priority", F.coalesce(F.create_map(*(F.lit(x) for p in PRIORITY.items() for x in p))[F.col("type")], F.lit(0)))


def within_budget(items: DataFrame, budget: int, group: str) -> DataFrame:
    """Each group's items in order of priority, then place, as long as their tokens together stay within the budget.

    Tokens are not negative, so taking items off the end while the sum is over is the same as a running sum within it.
    The sum goes over ranges of a group, so no task holds a whole one.
    """
    return running_sums(items, [group], [F.desc("priority"), F.asc("seq")], F.col("tokens")).where(F.col("running") <= budget)


def build_context(items: DataFrame, budget: int, group: str = "grp") -> DataFrame:
    """items: (group, seq, id, type, tokens). Deduplicated by id, prioritised, cut to the budget."""
    return within_budget(prioritised(keep_first(items, group, "id")), budget, group)
