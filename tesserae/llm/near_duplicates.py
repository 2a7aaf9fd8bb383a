"""Operator 6: near duplicates by bottom-k sketches from one hash function.

Rows of equal shingle sets form one class, whose least id stands for it. A class
keeps the least hash values of its set, k of them. Inverted lists of retained
values generate the pairs; the sketch of the union estimates the similarity and
drops pairs that are far off; the rest is confirmed on the full sets.

Similar sets have many retained values in common: the common ones among the least
values of their union are in both sketches, and those are a sample of the union.
So each class leaves as many of its retained values out of the lists, the most
frequent ones, as any similar pair has in common less one, but for a chance below
MISS a pair; all others that a second class has are listed. A passage that many
unlike texts share then brings no candidates together, as long as it is less than
about half of them. With ``exact`` the sketch is the set's complete prefix (similar
sets share one of their first n - ceil(num n / den) + 1 values in any one order) and
SPARE more, no pair is dropped by an estimate, and nothing is left to chance, at
several times the cost.

The lists are worked off in two steps. First only a few values of each class, the
rarest, are listed; that links nearly all that is to be linked. Then all others
are, and lists whose members are all in one component by now are done. Of the
rest, short ones give their pairs. In long ones, classes with too many shingles of
their own to be similar to any other are set aside, which is exact, and what is
left is compared whole, tile by tile, by matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import only, small_batches, squeezed, tidy, unsqueezed, written
from tesserae.llm.components import components
from tesserae.llm.wordhash import LOWER, Words, hash_words, mix, text_chunks

#: Values of a sketch; smaller sets are retained whole. The chance to miss a pair, and what an exact sketch holds beyond the prefix.
WHOLE, MISS, SPARE = 64, 1e-9, 24
#: Values listed in the first step, of those in few classes and of those in many; members of a list that gives its pairs,
#: at first and of those that are left at last.
FIRST_COLD, FIRST_HOT, HOT, SHORT = 8, 4, 8, 32
#: Values of the union's sketch, and the share of truly similar pairs, at most, that an estimate may drop.
ESTIMATED, RISK = 64, 1e-12
#: Members paired with one centre in a task, and of a tile.
SALTED, TILE = 256, 400


def prefix(n: int, num: int, den: int) -> int:
    """Of two similar sets, the least common value is among the first so many of either."""
    return n - -(-n * num // den) + 1


@cache
def tail(num: int, den: int, size: int, risk: float) -> int:
    """How many of ``size`` values of a union's sketch two similar sets have in common at least, but for a chance below
    ``risk``: the sketch is a sample of the union, and the binomial tail is above that of a sample without replacement."""
    p, below, least = num / den, 0.0, 0
    while below + (now := math.comb(size, least) * p**least * (1 - p) ** (size - least)) < risk:
        below, least = below + now, least + 1
    return least


@cache
def retained(num: int, den: int, exact: bool = False, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(values retained of a set of n, values that it may leave out of the lists), for n up to ``most``; for more as for ``most``,
    but for the exact prefix, which grows.

    Similar sets A and B, with spare(X) what is retained beyond the prefix, have min(spare(A), spare(B)) + 1 retained values in
    common; A may leave out as many as no set of a similar size spares less than. Sketches of a fixed size take tail() for it.
    """
    k = np.array([min(n, max(WHOLE, prefix(n, num, den) + SPARE) if exact else WHOLE) for n in range(most + 1)])
    spare = np.array([k[n] - prefix(n, num, den) if n and (exact or n <= WHOLE) else WHOLE for n in range(most + 1)])
    bound = SPARE if exact else max(0, tail(num, den, WHOLE, MISS) - 1)
    least = [min(spare[-(-n * num // den) : n * den // num + 1].min(), bound) if n else 0 for n in range(most + 1)]
    return k, np.array(least)


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; a text of fewer words has one shingle of all of them."""
    at, grams = words.ngrams(size)
    grams = grams.view(np.int64)
    cuts = np.searchsorted(at, words.bounds)
    short: dict[int, np.ndarray] = {}
    for n in range(1, size):
        of = np.flatnonzero(words.counts == n)
        if len(of):
            starts, whole = words.ngrams(n)
            short |= dict(zip(of.tolist(), whole.view(np.int64)[np.searchsorted(starts, words.bounds[of])].reshape(-1, 1), strict=True))
    none = np.zeros(0, np.int64)
    for t, n in enumerate(words.counts.tolist()):
        yield np.unique(grams[cuts[t] : cuts[t + 1]]) if n >= size else short.get(t, none)


def sketches(docs: DataFrame, *, shingle: int = 4, num: int = 80, den: int = 100, exact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, f1, f2, out, least): set size, 128-bit fingerprint of the set, values that may be left out, the retained values."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string("n long, f1 long, f2 long, out int, least array<long>").fields])
    keeps, outs = retained(num, den, exact)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(1)):
                n, f1, f2, out, least = [], [], [], [], []
                for s in shingle_sets(hash_words(data, offsets, LOWER), shingle):
                    x, size = s.view(np.uint64), len(s)
                    n.append(size)
                    f1.append(mix(x).sum(dtype=np.uint64))
                    f2.append(np.bitwise_xor.reduce(mix(x + np.uint64(0x5851F42D4C957F2D))) if size else np.uint64(0))
                    out.append(int(outs[min(size, len(outs) - 1)]))
                    least.append(s[: prefix(size, num, den) + SPARE if exact and size >= len(keeps) else int(keeps[min(size, len(keeps) - 1)])])
                numbers = [np.array(n, np.int64), *(np.array(f, np.uint64).view(np.int64) for f in (f1, f2)), np.array(out, np.int32)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, numbers), pa.array(least, pa.list_(pa.int64()))], names=schema.names)
        tidy()

    return rows.mapInArrow(make, schema)


def _sides(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs (a, b, salts) with ``columns`` of both as xa, xb. A centre's pairs are dealt by salt, and its row goes once to each."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")))
    side = lambda x: rows.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}{x}") for c in columns))
    centres = dealt.select("b", "salt").distinct().join(side("b"), "b")
    return dealt.join(side("a"), "a").join(centres, ["b", "salt"])


def _estimated(pairs: DataFrame, nodes: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    """Pairs (a, b, salts) that may be similar by the sketch of the union; sets held whole in their sketches are decided. If
    ``exact``, sizes and whole sets alone decide."""
    if exact:
        sizes = _sides(pairs, nodes.select("id", "n"), ["n"])
        return sizes.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).select("a", "b", "salts")
    few = nodes.select("id", "n", F.slice("least", 1, ESTIMATED).alias("s"))
    common = F.array_intersect("sa", "sb")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, ESTIMATED)
    enough = F.element_at(F.array(*(F.lit(tail(num, den, size, RISK)) for size in range(ESTIMATED + 1))), F.size(union) + 1)
    size_ok = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    # Sets within the sketch: intersection and union themselves.
    whole = (F.size(common) * den >= F.size(F.array_union("sa", "sb")) * num) & (F.greatest("na", "nb") <= WHOLE)
    rough = (F.greatest("na", "nb") > WHOLE) & (F.size(F.array_intersect(union, common)) >= enough)
    return _sides(pairs, few, ["n", "s"]).where(size_ok & (whole | rough)).select("a", "b", "salts")


def confirmed(pairs: DataFrame, docs: DataFrame, *, shingle: int, num: int, den: int, rows: int | None = None) -> DataFrame:
    """(u, v) of the pairs (a, b, salts) whose full sets have ``den * intersection >= num * union``; docs: (id, text).

    ``rows``: a bound of the different ids. The texts of both travel squeezed. Pairs of one centre come one after the other, and its set is made once.
    """
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b"))).distinct(), "ids", rows)
    texts = written(squeezed(only(docs, ids, "id")), "near-texts")
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for at in range(0, len(column), 50):
            for _, _, data, offsets in text_chunks(unsqueezed(column.slice(at, 50))):
                yield from shingle_sets(hash_words(data, offsets, LOWER), shingle)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, y = None, np.zeros(0, np.int64)
        for batch in batches:
            good, names = [], batch.column(1).to_pylist()
            for i, x in enumerate(sets(batch.column(2))):
                if names[i] != centre or centre is None:
                    centre, y = names[i], next(sets(batch.column(3).slice(i, 1)))
                # A set is retained whole where it is small; which of equal ids' texts is meant doesn't matter here.
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])
        tidy()

    return _sides(pairs, texts, ["text"]).select("a", "b", "texta", "textb").mapInArrow(compare, schema)


def near_duplicates(docs: DataFrame, *, shingle: int = 4, num: int = 80, den: int = 100, exact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row.

    A text's set is that of its distinct ``shingle``-word shingles over words
    between ASCII white space with A-Z lowered; fewer words are one shingle; no
    words (or a null text) is the empty set, which is linked with nothing. Texts
    with ``den * intersection >= num * union`` are linked; ``component_id`` is the
    least id reachable, ``kept`` marks the row that has it. Rows with a null id
    are linked with nothing (null component, kept). Rows of one repeated id count
    as one document. An empty table gives no rows. Very long texts are read whole
    and hashed in blocks. ``exact`` finds candidates without any chance of a miss.
    """
    small_batches(docs.sparkSession)
    made = written(sketches(docs, shingle=shingle, num=num, den=den, exact=exact, id_col=id_col, text_col=text_col), "sketches")
    n_docs = made.count()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    real = made.where("n > 0 AND id IS NOT NULL")
    classes = written(real.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")), "class-ids", n_docs)
    nodes = written(made.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "classes", n_docs)
    edges = _links(nodes, texts, shingle, num, den, exact, n_docs)
    # Rows of one id in several classes join these.
    same = real.join(classes, ["f1", "f2", "n"]).where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    repeated = same.join(nodes.select(F.col("id").alias("u")).distinct(), "u", "left_semi")
    if repeated.limit(1).count():
        edges = components(edges.unionByName(repeated))
    of = classes.join(edges.select(F.col("u").alias("rep"), F.col("v").alias("c")), "rep", "left").select("f1", "f2", "n", F.coalesce("c", "rep").alias("c"))
    out = made.join(of, ["f1", "f2", "n"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("id").isNotNull(), F.col("c")), F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows, all columns, of one document of each component (the least id). Rows of one id are one document: of these the one
    with the least text stays (null last), of equal texts the least in its other columns. Rows without an id stay."""
    key = F.col(id_col)
    kept = written(near_duplicates(docs, id_col=id_col, text_col=text_col, **how).where(F.col("kept") & key.isNotNull()).select(id_col).distinct(), "kept")
    chosen = only(docs, kept, id_col)
    if docs.where(key.isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count():
        others = [c for c in docs.columns if c not in (id_col, text_col)]
        whole = F.struct(F.col(text_col).isNull(), F.col(text_col), *(F.col(f"`{c}`") for c in others), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
        chosen = chosen.groupBy(id_col).agg(F.min(whole)["_row"].alias("_row")).select("_row.*")
    return chosen.unionByName(docs.where(key.isNull()))


def _links(nodes: DataFrame, texts: DataFrame, shingle: int, num: int, den: int, exact: bool, n_docs: int) -> DataFrame:
    """The components of the classes (``n_docs`` at most), as in components()."""
    values = nodes.select("id", "f1", "f2", F.explode("least").alias("value"))
    held = written(values.groupBy("value").agg(F.count("*").alias("held")).where("held > 1"), "held")
    shared = values.join(held, "value").groupBy("id", "f1", "f2").agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("shared"))
    # The values that no other class has come first in the order, the most frequent ones last; these are left out.
    k = F.size("least")
    listed = nodes.join(shared, ["id", "f1", "f2"]).select(
        "id", "n", ((k - F.size("shared")) / k).alias("apart"), F.size(F.filter("shared", lambda x: x["held"] <= HOT)).alias("cold"),
        F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.size("shared") - F.col("out"))).alias("shared"),
    )
    lists = listed.select("id", "n", "apart", "cold", F.posexplode("shared").alias("at", "e"))
    # The values of the first step: the rarest of either kind.
    is_hot = F.col("e.held") > HOT
    early = F.when(is_hot, F.col("at") - F.col("cold") < FIRST_HOT).otherwise(F.col("at") < FIRST_COLD)
    lists = written(lists.select("id", "n", "apart", F.col("e.value").alias("value"), is_hot.alias("is_hot"), early.alias("early")), "lists")
    n_listed = lists.count()

    def all_pairs(short: DataFrame) -> DataFrame:
        """The pairs within short lists."""
        ids = short.groupBy("value").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) > 1")
        each = ids.select(F.explode("ids").alias("a"), "ids").select("a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b"))
        return each.distinct().withColumn("salts", F.lit(1))

    def centred(members: DataFrame) -> DataFrame:
        """Every member of a list with the list's member that is least apart; of equal ones that of the least hash."""
        centre = members.groupBy("value").agg(F.min_by("id", F.struct("apart", F.xxhash64("id"))).alias("b"), F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
        return members.join(written(centre, "centres", n_listed), "value").where("id <> b").groupBy(F.col("id").alias("a"), "b").agg(F.max("salts").alias("salts"))

    def test(pairs: DataFrame) -> DataFrame:
        close = written(_estimated(pairs, nodes, num, den, exact), "pairs")
        found = confirmed(close, texts, shingle=shingle, num=num, den=den, rows=n_docs) if close.limit(1).count() else close.select(F.col("a").alias("u"), F.col("b").alias("v"))
        return written(found, "links")

    def several(members: DataFrame, labels: DataFrame) -> DataFrame:
        """The members of lists that hold several labels, with theirs (c)."""
        named = members.join(labels, "id", "left").withColumn("c", F.coalesce("c", "id"))
        mixed = written(named.groupBy("value").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("value"), "mixed", n_listed)
        return written(named.join(mixed, "value"), "open", n_listed)

    def linked(short: DataFrame, edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges and labels after the pairs of different labels within short lists are tested."""
        if short.isEmpty():
            return edges, labels
        pairs = all_pairs(short)
        by = labels.select(F.col("id").alias("a"), F.col("c").alias("ca")), labels.select(F.col("id").alias("b"), F.col("c").alias("cb"))
        more = test(pairs.join(by[0], "a", "left").join(by[1], "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "salts"))
        if more.limit(1).count():
            edges = components(edges.unionByName(more))
            labels = _labels(edges, n_docs)
        return edges, labels

    first = lists.where("early")
    edges = components(test(all_pairs(first.where("NOT is_hot")).unionByName(centred(first.where("is_hot")))))
    labels = _labels(edges, n_docs)
    open_ = several(lists, labels)
    edges, labels = linked(open_.where("NOT is_hot"), edges, labels)
    open_ = several(open_.where("is_hot").select("id", "n", "value"), labels)
    if not open_.limit(1).count():
        return edges
    own = written(_own(written(open_.select("id").distinct(), "ids", n_docs), texts, shingle), "own")
    members = open_.select("id", "n", "value").join(own, "id", "left").where((F.col("n") - F.coalesce("own", F.lit(0))) * den >= F.col("n") * num)
    open_ = several(members.select("id", "value"), labels)
    size = written(open_.groupBy("value").agg(F.count("*").alias("k")), "sizes", n_listed)
    short = open_.join(size.where(F.col("k") <= SHORT).select("value"), "value", "left_semi")
    edges, labels = linked(short, edges, labels)
    open_ = several(open_.join(size.where(F.col("k") > SHORT).select("value"), "value", "left_semi").select("id", "value"), labels)
    if not open_.limit(1).count():
        return edges
    return components(edges.unionByName(_within_families(open_, texts, shingle, num, den)))


def _labels(edges: DataFrame, rows: int) -> DataFrame:
    """(id, c): the component of each class that is linked with another."""
    return written(edges.select(F.col("u").alias("id"), F.col("v").alias("c")).union(edges.select("v", "v").distinct()), "labels", rows)


def _within_families(open_: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(u, v): links within the families that open lists form, enough of them to connect what is linked.

    A family's members are dealt into tiles of about TILE, a large component's into
    tiles of its own, and each pair of tiles that may hold two components is
    compared in a task by the products of their incidence matrices, which counts
    the common shingles of all pairs without a row for any. Texts travel squeezed.
    A task returns a spanning tree of each component that it finds.
    """
    least = open_.groupBy("value").agg(F.min("c").alias("v"))
    family = components(open_.select("c", "value").distinct().join(written(least, "least"), "value").select(F.col("c").alias("u"), "v"))
    member = open_.select("id", "c").distinct().join(family.withColumnRenamed("u", "c"), "c", "left").select("id", "c", F.coalesce("v", "c").alias("family"))
    member = written(member, "members")
    size = member.groupBy("family", "c").agg(F.count("*").alias("k"))
    size = size.withColumn("alone", F.col("k") * 2 > TILE)
    total = size.where("NOT alone").groupBy("family").agg(F.ceil(F.sum("k") / TILE).cast("int").alias("pools"))
    # Tiles have names: a large component's parts, or a pool of small components.
    named = member.join(written(size.join(total, "family", "left"), "sizes"), ["family", "c"])
    part = F.when(F.col("alone"), F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / TILE))).otherwise(F.pmod(F.xxhash64("c"), F.col("pools"))).cast("int")
    named = written(named.select("family", "id", "c", F.struct(F.when(F.col("alone"), F.col("c")).alias("only"), part.alias("part")).alias("tile")), "tiles")
    tiles = named.select("family", "tile").distinct()
    other = tiles.select("family", F.col("tile").alias("other"))
    pairs = tiles.join(other, "family").where("tile < other OR tile = other AND tile.only IS NULL").where(F.coalesce(F.col("tile.only") != F.col("other.only"), F.lit(True)))
    pairs = written(pairs.select("family", F.col("tile").alias("a"), F.col("other").alias("b")), "tile-pairs")
    kind = member.schema["id"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])
    squeezed_texts = squeezed(only(texts, named.select("id").distinct(), "id").distinct())
    rows = named.join(squeezed_texts, "id").withColumn("key", F.xxhash64("family", "tile"))
    ends = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"), "family", "a", "b")
    placed = rows.join(ends, ["family", "tile"]).select("family", "a", "b", (F.col("tile") == F.col("a")).alias("first"), "id", "c", "text")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        ids, c, first = (np.array(table[x].to_pylist()) for x in ("id", "c", "first"))
        sets = [s for at in range(0, table.num_rows, 50) for _, _, data, offsets in text_chunks(unsqueezed(table["text"].slice(at, 50))) for s in shingle_sets(hash_words(data, offsets, LOWER), shingle)]
        size = np.array([len(s) for s in sets])
        _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = held[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, [at, at + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[row[lo:hi], column[lo:hi] - at] = 1
            both += part @ part.T
        linked = (both > 0) & (den * both >= num * (size[:, None] + size[None, :] - both)) & (ids[:, None] != ids[None, :])
        if len(set(first.tolist())) > 1:
            linked &= first[:, None] != first[None, :]
        # Least labels spread over the links; members known to be linked start with one label.
        label = np.unique(c, return_inverse=True)[1]
        x, y = np.nonzero(linked)
        u, v = [], []
        while len(differs := np.flatnonzero(label[x] != label[y])):
            i = differs[0]
            u.append(ids[x[i]])
            v.append(ids[y[i]])
            old, new = max(label[x[i]], label[y[i]]), min(label[x[i]], label[y[i]])
            label[label == old] = new
        return pa.Table.from_arrays([pa.array(u, table.schema.field("id").type), pa.array(v, table.schema.field("id").type)], names=["u", "v"])

    return placed.groupBy("family", "a", "b").applyInArrow(compare, schema)


def _own(ids: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(id, own): how many of a class's shingles no other of these classes has."""
    rows = only(texts, ids, "id").distinct()
    schema = T.StructType([rows.schema["id"], T.StructField("s", T.LongType())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in text_chunks(batch.column(1)):
                sets = list(shingle_sets(hash_words(data, offsets, LOWER), shingle))
                of = np.repeat(np.arange(a, a + len(sets)), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(np.concatenate(sets))], names=["id", "s"])

    once = rows.select("id", "text").mapInArrow(spread, schema).groupBy("s").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1")
    return once.groupBy("id").agg(F.count("*").alias("own"))
