"""Running sums of groups of any size.

A window keeps a whole group in one task. Here the rows are split into ranges of
group and order, so a large group takes many ranges; each range makes its own
running sum, the ranges' totals (a row for each group and range) give what
comes before each of them, and that is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.lineage import stored


def running_sums(rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str = "running", parts: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the group's rows up to each row, by ``order``.

    Without a group it is one sum over the table. A null is a group of its own, a null value adds nothing. Ties in the order
    come in any order, so it should be total. The ranges are kept in a table: their bounds come from a sample, and a second
    run would draw others.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(rows.withColumn("_value", F.coalesce(value, F.lit(0))).repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = ranges.withColumn(name, F.sum("_value").over(Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    sums = ranges.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_part").alias("_p"), F.sum("_sum").over(earlier).alias("_before"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)), F.col("_part") == F.col("_p"))
    return own.join(before, same).select(*rows.columns, (F.col(name) + F.coalesce("_before", F.lit(0))).alias(name))


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in the group, from 1."""
    return running_sums(rows, group, order, F.lit(1), name)
