"""A trie of conversations' prefixes, by van Emde Boas recursion.

Sequences of a height (a power of two) are cut at half of it. What lies before
the cut is an upper part, what lies after it belongs to the lower forest under
the name of the cut prefix; both halves are cut again in the same way. All parts
of one height, upper and lower, are one step, so the steps are twice the
logarithm of the longest conversation, however many conversations there are:

* names, from the largest height to the least: a cut prefix is named by a digest of
  the name where its part starts and of the turns up to the cut. The digests of runs
  of 1, 2, 4, ... turns come from the pairs of the height below.
* totals, from the least height to the largest: a node knows what is under it in its
  own part. Two parts become one when the totals of each lower tree's tops are added
  (grafted) to all nodes of the upper part that lead to the tree's cut prefix.

A turn is one row of 16 bytes and a count throughout, keyed by conversation and
place, so a long conversation is spread like many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import remove, small_batches, written
from tesserae.operators.running import ranked

ROOT = b"\0" * 16


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, place, turn, bytes): a conversation's turns from place 1, by turn, null first, rows of one turn by their digests.
    ``turn`` is the digest of role and text, a null being empty; ``bytes`` are the text's. A null conv_id is no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("turn"), F.octet_length(text).cast("long").alias("bytes")
    )
    return ranked(one, ["conv"], [F.asc_nulls_first("at"), F.asc("turn")], "place").select("conv", F.col("place").cast("long").alias("place"), "turn", "bytes")


def rebuilt(own: DataFrame, *, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv, place, turn, bytes) and (conv, length): every conversation c begins with the first crc32(c) % ``most`` turns of
    conversation c - c % ``group`` (all if it has fewer, none if there is no such), then come its own turns after as many."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = own.groupBy("conv").agg(F.max("place").alias("n")).withColumns({"h": h, "base": F.col("conv") - F.col("conv") % group})
    # At most ``most`` turns of a base.
    heads = own.where(F.col("place") < most).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "turn", "bytes"))).alias("head"))
    taken = F.slice(F.coalesce("head", F.expr("array()").cast("array<struct<place:bigint,turn:binary,bytes:bigint>>")), F.lit(1), F.col("h").cast("int"))
    convs = written(convs.join(heads, "base", "left").withColumn("head", taken).withColumn("skip", F.size("head").cast("long")), "rebuilt")
    first = convs.select("conv", F.inline("head"))
    rest = own.join(convs.select("conv", "h", "skip"), "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("skip")).alias("place"), "turn", "bytes")
    return first.unionByName(rest), convs.select("conv", (F.col("skip") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def named(seqs: DataFrame, lengths: DataFrame, levels: int) -> DataFrame:
    """(conv, depth, name) of every prefix but the empty one: equal prefixes, and no others, have equal names."""
    runs = [seqs.select("conv", (F.col("place") - 1).alias("part"), F.col("turn").alias("run"))]
    for _ in range(1, levels):
        half = F.col("part") % 2
        pairs = runs[-1].groupBy("conv", F.floor(F.col("part") / 2).alias("part")).agg(F.max(F.when(half == 0, F.col("run"))).alias("a"), F.max(F.when(half == 1, F.col("run"))).alias("b"))
        runs.append(written(pairs.where("a IS NOT NULL AND b IS NOT NULL").select("conv", "part", _digest(F.col("a"), F.col("b")).alias("run")), "runs"))
    known = [lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"))]
    for level in reversed(range(levels)):
        height = 1 << level
        # Parts of twice this height start where a name is known; their first halves lead to the cuts.
        cuts = runs[level].where("part % 2 = 0").select("conv", (F.col("part") * height).alias("depth"), "run")
        starts = known[0]
        for more in known[1:]:
            starts = starts.unionByName(more)
        known.append(written(starts.join(cuts, ["conv", "depth"]).select("conv", (F.col("depth") + height).alias("depth"), _digest(F.col("name"), F.col("run")).alias("name")), "names"))
    remove(*runs[1:])
    out = known[1]
    for more in known[2:]:
        out = out.unionByName(more)
    return out


def _ends(rows: DataFrame) -> DataFrame:
    """(name, ends_sha256) of rows (name, conv): ids in order, joined by commas. A node's ids stream through the hash, sorted, so a
    node with very many takes time in one task (a digest is made in order) but no memory."""
    small_batches(rows.sparkSession)

    def digests(batches):
        import hashlib

        import pyarrow as pa

        last, state = None, None
        for batch in batches:
            names, found = [], []
            for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != last:
                    if state is not None:
                        names.append(last)
                        found.append(state.hexdigest())
                    last, state = name, hashlib.sha256(b"%d" % conv)
                else:
                    state.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.string())], names=["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])

    return rows.select("name", "conv").repartition("name").sortWithinPartitions("name", "conv").mapInArrow(digests, "name binary, ends_sha256 string")


def prefix_trie(seqs: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences (conv, place, turn, bytes; places from 1 without gaps) with these (conv, length), which
    also name conversations without a turn.

    One row for each distinct prefix, the empty one included: conv_id (its smallest member), depth, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves and saved_tokens over the subtree, ends_sha256. Conversation ids are distinct and
    not null. Without a conversation there is no row.
    """
    seqs = written(seqs.select("conv", "place", "turn", "bytes"), "turns")
    lengths = written(lengths.select("conv", "length"), "lengths")
    longest = lengths.agg(F.max("length")).first()[0] or 0
    levels = longest.bit_length()
    names = named(seqs, lengths, levels) if levels else seqs.select("conv", F.col("place").alias("depth"), F.col("turn").alias("name")).limit(0)
    places = written(names.join(seqs.select("conv", F.col("place").alias("depth"), "bytes"), ["conv", "depth"]), "places")
    tops = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"))
    everywhere = places.select("conv", "depth", "name").unionByName(tops)

    nodes = places.unionByName(tops.withColumn("bytes", F.lit(0).cast("long"))).groupBy("name").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    above = everywhere.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = written(nodes.join(above, ["conv", "depth"], "left"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    heads = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"))
    kids = F.coalesce("n_children", F.lit(0))
    nodes = written(nodes.join(children, "name", "left").withColumn("n_children", kids).join(heads, "parent", "left"), "nodes")
    totals = nodes.select("name", "depth", "parent_conv", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))

    for level in range(levels + 1):
        height = 1 << level
        # The tops of lower trees; the last step's are all under the root, which is no part's.
        last = level == levels
        trees = totals.where("depth = 1" if last else f"depth > 0 AND (depth - 1) % {2 * height} = {height}")
        grafts = trees.groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("cut")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        if last:
            to = grafts.select(F.lit(ROOT).alias("name"), "l", "s")
        else:
            part = F.floor((F.col("depth") - 1) / height)
            upper = places.select("conv", part.alias("part"), "name")
            to = grafts.withColumn("part", F.floor(F.col("cut") / height) - 1).join(upper, ["conv", "part"]).groupBy("name").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
        after = written(totals.join(to, "name", "left").select("name", "depth", "parent_conv", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "totals")
        if level:
            remove(totals)
        totals = after

    ends = _ends(everywhere.join(lengths.select("conv", F.col("length").alias("depth")), ["conv", "depth"]))
    out = nodes.join(totals.select("name", "leaves", "saved"), "name").join(ends, "name", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, *, group: int = 5, most: int = 9) -> DataFrame:
    """prefix_trie() of the rebuilt() turns() of a table (conv_id, turn, role, text); other columns don't matter."""
    own = written(turns(conversations), "own")
    return prefix_trie(*rebuilt(own, group=group, most=most))
