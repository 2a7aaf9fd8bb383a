"""Mixing of sources to target weights by entropy balancing.

Each document has a rate, the number of times that the mix takes it. Of all
rates between 0 and ``most`` that give every source its target of words, those
nearest to the even rate (in relative entropy) are an exponential tilt of it:

    rate = min(most, even * exp(dual * size / the source's mean size))

with one dual value for each source, where the convex dual is least. Newton
steps find all of them at once: each is one aggregation over a table of
(source, size, number of documents), which says as much as the documents and
grows with the different sizes only. Rates become whole copies in parts of a
source of about PART documents, which carry what rounding leaves from the
largest document to the smallest. Everything is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import BROADCAST_BYTES, remove, written
from tesserae.operators.running import ranked

#: Documents that are rounded together, about; relative difference from its target at which a source's search ends; steps at most.
PART, NEAR, STEPS = 1024, 1e-9, 60


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size): words between ASCII white space; a null text has none. Repeated rows stay repeated."""
    words = F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def source_targets(sized: DataFrame, share: float, weights: tuple[int, ...], most: float) -> DataFrame:
    """(source, sid, n, source_size, squares, least_size, target) of each source, a null source being one.

    The sources in code-point order, null last, have ``weights`` in turn. By weight they share ``share`` of all words; a
    target stops at ``most`` times its source's words and the others share what is over, until none is above.
    """
    each = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least_size"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    known = written(ranked(each, [], [F.asc_nulls_last("source")], "sid").withColumn("weight", turn), "sources")
    total = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # each round's level is higher, so more sources are full; it ends when no more are
        over = F.col("weight") * level >= F.col("source_size") * most
        row = known.agg(F.count_if(over).alias("full"), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open")).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (total - most * row["held"]) / row["open"]
    return known.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), F.col("source_size") * F.lit(float(most))) if row["open"] else F.col("source_size") * F.lit(float(most))).drop("weight")


def _rate(even: float, most: float) -> Column:
    """A document's rate by its source's dual value; full sources are taken ``most`` times."""
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.lit(float(even)) * F.exp(F.col("dual") * F.col("size") / F.col("mean"))))


def _few(sources: DataFrame) -> bool:
    """Whether the sources' columns may be broadcast: their size is counted. Beyond that Spark splits large sources in the joins."""
    size = sources.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("source", F.lit(""))) + 128), F.lit(0))).first()[0]
    return size <= BROADCAST_BYTES


def _joined(rows: DataFrame, sources: DataFrame, key: str, few: bool) -> DataFrame:
    other = sources.withColumnRenamed(key, "_key")
    return rows.join(F.broadcast(other) if few else other, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def balanced(sized: DataFrame, sources: DataFrame, even: float, most: float, few: bool) -> DataFrame:
    """The sources with ``dual``, ``mean`` and ``full``: see the module. Newton steps on the logarithm of the words that a
    source's rates take, which leave no known bracket of the solution; a step that would is a bisection."""
    size, target = F.col("source_size").cast("double"), F.col("target")
    mean = size / F.col("n")
    at_zero = size * even
    ratio = F.log(target / at_zero)
    least = F.col("least_size") / mean
    up = target >= at_zero
    first = ratio * size * mean / F.col("squares")  # exact for documents of one size
    state = sources.withColumns({"full": (F.col("source_size") == 0) | (target >= size * most * (1 - 1e-12)), "mean": mean})
    state = state.withColumns({"low": F.when(up, 0.0).otherwise(ratio / least), "high": F.when(up, F.lit(math.log(most / even)) / least).otherwise(0.0)})
    state = written(state.withColumns({"dual": F.when(F.col("full"), 0.0).otherwise(F.least(F.greatest(first, "low"), "high")), "done": F.col("full")}), "duals")
    cells = written(_joined(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("k")), state.where("NOT full").select("source", "sid"), "source", few).select("sid", "size", "k"), "cells")
    for _ in range(STEPS):
        if not state.where("NOT done").limit(1).count():
            break
        at = _joined(cells, state.where("NOT done").select("sid", "dual", "mean", "full"), "sid", few).withColumn("rate", _rate(even, most))
        words = F.col("k") * F.col("size") * F.col("rate")
        sums = at.groupBy("sid").agg(F.sum(words).alias("words"), F.sum(F.when(F.col("rate") < most, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        seen = state.join(sums, "sid", "left")
        low = F.when(F.col("words") < target, F.col("dual")).otherwise(F.col("low"))
        high = F.when(F.col("words") >= target, F.col("dual")).otherwise(F.col("high"))
        step = F.col("dual") - (F.log("words") - F.log(target)) * F.col("words") / F.col("slope")
        inside = F.coalesce((step > low) & (step < high), F.lit(False))
        near = F.abs(F.col("words") - target) <= target * NEAR
        moved = {"dual": F.when(F.col("done") | near, F.col("dual")).when(inside, step).otherwise((low + high) / 2), "low": F.when(F.col("done"), F.col("low")).otherwise(low), "high": F.when(F.col("done"), F.col("high")).otherwise(high), "done": F.col("done") | near | (high - low <= 1e-15 * F.abs(high))}
        after = written(seen.withColumns(moved).select(*state.columns), "duals")
        remove(state)
        state = after
    remove(cells)
    return state


def mix(docs: DataFrame, *, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(``id_col``, source, size, source_size, target, rate, copies, taken) of each document of ``docs``.

    ``copies`` is a whole number from 0 to ``most``, ``taken`` is size times copies. A source's taken words differ from its
    target by about half of a small document for each PART documents; where a few large documents make up a source there may be no
    better whole numbers. An empty or null text has no words; it has copies by its rate and takes nothing. Null ids and
    sources are kept (null is a source), repeated rows are documents of their own, an empty table gives none, other columns
    don't matter whatever their names. The same rows give the same copies.
    """
    even = float(share)
    sized = written(sizes(docs, id_col, source_col, text_col), "sizes")
    sources = source_targets(sized, share, weights, most)
    few = _few(sources)
    state = balanced(sized, sources, even, most, few)
    rated = _joined(sized, state.select("source", "sid", "n", "source_size", "target", "dual", "mean", "full"), "source", few).withColumn("rate", _rate(even, most))
    mixed_up = F.xxhash64("id", "size")
    part = rated.withColumn("_part", F.pmod(mixed_up, F.ceil(F.col("n") / PART))).groupBy("sid", "_part").agg(
        F.first("source").alias("source"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sort_array(F.collect_list(F.struct("size", mixed_up.alias("tie"), "id", "rate")), asc=False).alias("docs"),
    )

    def carried(so_far: Column, doc: Column) -> Column:
        # Rounds the rate and what is left of larger documents, and passes on what that leaves.
        copies = F.least(F.greatest(F.round(doc["rate"] + F.when(doc["size"] > 0, so_far["left"] / doc["size"]).otherwise(0.0)), F.lit(0.0)), F.lit(float(most)))
        return F.struct((so_far["left"] + (doc["rate"] - copies) * doc["size"]).alias("left"), F.concat(so_far["copies"], F.array(copies.cast("int"))).alias("copies"))

    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<int>").alias("copies"))
    copies = F.aggregate("docs", start, carried, lambda x: x["copies"])
    rows = part.withColumn("copies", copies).select("source", "source_size", "target", F.explode(F.arrays_zip("docs", "copies")).alias("d"))
    size, times = F.col("d.docs.size"), F.col("d.copies")
    return rows.select(F.col("d.docs.id").alias(id_col), "source", size.alias("size"), "source_size", "target", F.col("d.docs.rate").alias("rate"), times.alias("copies"), (size * times).alias("taken"))


def mixture(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents themselves, each as often as ``mixed`` (of mix()) takes it; ids must be unique and not null."""
    times = mixed.where("copies > 0").select(F.col(id_col).alias("_id"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return docs.join(times.select("_id"), docs[id_col] == F.col("_id")).select(*(docs[c] for c in docs.columns))
