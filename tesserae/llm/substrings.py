"""Operator 9: removal of repeated word spans, by fixed-block anchors.

The index holds every text's non-overlapping blocks of ``block = (window + 1) //
2`` words; any window of ``window`` words contains a whole block of whichever
text it is also found in. Every rolling block-sized run of words probes the
index; windows around a hit are then compared by 96 bits of two hashes (of 10^13
windows not one pair is expected to agree by chance), and runs of neighbouring
repeated windows are the maximal exact repeats.

Texts are dealt to groups and ordered by key there, so a word is named by its
group and its place among the group's words, and rows between stages carry no text
keys. Index and probes meet by hash bucket, each a shuffle partition of its own. A
group sends one packed row for each bucket (hashes, steps from place to place) and
SEND_WORDS instead of one row for each word; runs that a group itself holds
twice are known to repeat and one of them stands for all, so a passage found
everywhere costs a bucket one entry for each such row, not for each occurrence.
The numbers of groups and buckets follow the input's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import keyed_columns, partitions, renamed, small_batches, squeezed, text_bytes, unsqueezed
from tesserae.llm.wordhash import Words, hash_words, text_chunks

BUCKET_BYTES, GROUP_BYTES, SEND_WORDS = 8 << 20, 8 << 20, 400_000
#: A step of this length goes on with the next one.
FAR = 0xFFFF

_PACKED = "bucket int, dest int, first long, hashes binary, steps binary"
_FOUND = "dest int, first long, steps binary"


def _steps(places: np.ndarray) -> tuple[int, bytes]:
    """Rising places as the first one and 16-bit steps: their low bytes, then their high bytes (which compress well)."""
    step = np.diff(places, prepend=places[0])
    out = np.full(len(step) + int((step // FAR).sum()), FAR, "<u2")
    out[(step // FAR + 1).cumsum() - 1] = step % FAR
    return int(places[0]), out.view(np.uint8).reshape(-1, 2).T.tobytes()


def _places(first: int, steps: bytes) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(2, -1).T).view("<u2").ravel()
    return (first + step.cumsum(dtype=np.int64))[step != FAR]


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *arrays])


def _send(grams: np.ndarray, places: np.ndarray, extra: np.ndarray, anchored: bool, dest: int, buckets: int, turn: int) -> Iterator[tuple]:
    """Rows of _PACKED. Grams found twice here go, as known, without hashes; one of each kind of gram goes to its bucket.

    ``extra`` marks anchors (31 bits of the hash and the mark are sent), or is the second hash (both are sent, 96 bits).
    """
    order = np.argsort(grams, kind="stable") if anchored else np.lexsort([extra, grams])
    new = np.ones(len(grams), bool)
    new[1:] = grams[order[1:]] != grams[order[:-1]]
    if not anchored:
        new[1:] |= extra[order[1:]] != extra[order[:-1]]
    first = np.flatnonzero(new)
    many = np.diff(first, append=len(grams)) > 1
    if many.any():
        at, steps = _steps(places[np.sort(order[np.repeat(many, np.diff(first, append=len(grams)))])])
        yield turn % buckets, dest, at, b"", steps
    one = order[first]
    marked = np.logical_or.reduceat(extra[order], first) if anchored else None
    by_place = np.argsort(one)
    one = one[by_place]
    bucket = ((grams[one] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    if anchored:
        short = ((grams[one] & np.uint64(0xFFFFFFFE)) | marked[by_place]).astype("<u4")
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        mine = by[cuts[b] : cuts[b + 1]]
        i = one[mine]
        at, steps = _steps(places[i])
        yield int(b), dest, at, short[mine].tobytes() if anchored else grams[i].tobytes() + extra[i].astype("<u4").tobytes(), steps


def _meet(anchored: bool, names: list[str]):
    """Within a bucket: the places whose hash another entry shares (with an anchor among them, if anchored)."""

    def meet(table: pa.Table) -> pa.Table:
        rows = table.select(["dest", "first", "hashes", "steps"]).to_pylist()
        known, sent = [r for r in rows if not r["hashes"]], [r for r in rows if r["hashes"]]

        def taken(which: list[dict]) -> tuple[np.ndarray, np.ndarray]:
            places = [_places(r["first"], r["steps"]) for r in which]
            return np.repeat(np.array([r["dest"] for r in which], np.int64), [len(p) for p in places]), _joined(places)

        dest, place = taken(sent)
        if anchored:
            hashes = np.frombuffer(b"".join(r["hashes"] for r in sent), "<u4")
            order = np.argsort(hashes >> np.uint32(1), kind="stable")
            new = np.concatenate([[True], np.diff(hashes[order] >> np.uint32(1)) != 0])[: len(order)]
        else:
            n = [len(r["hashes"]) // 12 for r in sent]
            hashes = np.frombuffer(b"".join(r["hashes"][: 8 * k] for r, k in zip(sent, n, strict=True)), "<u8")
            second = np.frombuffer(b"".join(r["hashes"][8 * k :] for r, k in zip(sent, n, strict=True)), "<u4")
            order = np.lexsort([second, hashes])
            new = np.concatenate([[True], (np.diff(hashes[order]) != 0) | (np.diff(second[order]) != 0)])[: len(order)]
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(hashes))
        good = size > 1
        if anchored and len(first):
            good &= np.logical_or.reduceat((hashes[order] & 1).astype(bool), first)
        hit = order[np.repeat(good, size)]
        dest, place = (np.concatenate([x[hit], more]) for x, more in zip((dest, place), taken(known), strict=True))
        by = np.lexsort([place, dest])
        dest, place = dest[by], place[by]
        cuts = np.flatnonzero(np.diff(dest, prepend=-1, append=-1))
        out = [(int(dest[a]), *_steps(place[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=names)

    return meet


def _ordered(docs: pa.Table) -> pa.Table:
    """A group's texts by key. Texts of equal keys are equal, so a place means the same word whenever this is done again."""
    return docs.take(np.lexsort([docs["k2"].to_numpy(), docs["k1"].to_numpy()]))


def _hashed(docs: pa.Table) -> Iterator[tuple[int, Words]]:
    """(place in the group of the first of the words, the words) of runs of a group's texts."""
    at = 0
    for _, _, data, offsets in text_chunks(unsqueezed(_ordered(docs)["text"])):
        words = hash_words(data, offsets)
        yield at, words
        at += len(words.hashes)


def _found(hits: pa.Table) -> np.ndarray:
    """All found places of a group, rising."""
    rows = hits.select(["first", "steps"]).to_pydict()
    return np.unique(_joined([_places(f, s) for f, s in zip(rows["first"], rows["steps"], strict=True)]))


def _repeated(small: DataFrame, window: int, buckets: int, dests: int) -> DataFrame:
    """Rows of _FOUND: where windows start whose words also start elsewhere. ``small``: k1, k2, dest and squeezed texts."""
    block = (window + 1) // 2
    packed, found = T._parse_datatype_string(_PACKED), T._parse_datatype_string(_FOUND)
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def rows(sent: list[tuple]) -> pa.Table:
        return pa.table([pa.array([r[c] for r in sent], t) for c, t in enumerate(kinds)], names=packed.names)

    def probe(docs: pa.Table) -> pa.Table:
        dest, held, out, size, packs = docs["dest"][0].as_py(), [], [], 0, 0

        def send() -> None:
            grams, places = (np.concatenate(x) for x in zip(*((g, p) for g, p, _ in held), strict=True))
            anchors = np.concatenate([x for _, _, x in held])
            held.clear()
            out.extend(_send(grams, places, anchors, True, dest, buckets, dest + packs))

        for first, words in _hashed(docs):
            at, grams = words.ngrams(block)
            text = words.text_of()[at]
            long_enough = words.counts[text] >= window
            at, grams, text = at[long_enough], grams[long_enough], text[long_enough]
            held.append((grams, first + at, (at - words.bounds[text]) % block == 0))
            size += len(at)
            if size >= SEND_WORDS:
                send()
                size, packs = 0, packs + 1
        if size:
            send()
        return rows(out)

    def compare(docs: pa.Table, hits: pa.Table) -> pa.Table:
        hit, held = _found(hits), []
        for first, words in _hashed(docs):
            lo, hi = np.searchsorted(hit, [first, first + len(words.hashes)])
            if hi == lo:
                continue
            mark = np.zeros(len(words.hashes) + 1, np.int64)
            mark[1 + hit[lo:hi] - first] = 1
            seen = mark.cumsum()
            at, grams = words.ngrams(window)
            near = seen[at + window - block + 1] > seen[at]
            if near.any():
                held.append((grams[near], first + at[near], (words.checks(window)[near] >> np.uint64(32)).astype(np.uint32)))
        if not held:
            return rows([])
        dest = docs["dest"][0].as_py()
        return rows(list(_send(*(np.concatenate(x) for x in zip(*held, strict=True)), False, dest, buckets, dest)))

    by = lambda df, n, c: df.repartitionById(n, F.col(c)).groupBy(c)
    hits = by(by(small, dests, "dest").applyInArrow(probe, packed), buckets, "bucket").applyInArrow(_meet(True, found.names), found)
    windows = by(small, dests, "dest").cogroup(by(hits, dests, "dest")).applyInArrow(compare, packed)
    return by(windows, buckets, "bucket").applyInArrow(_meet(False, found.names), found)


def remove_repeats(docs: DataFrame, *, window: int = 35, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text", carried: list[Column] | None = None) -> DataFrame:
    """(carried columns, by default the id; n_words, n_removed, kept_sha256[, kept_text]) for each row.

    Words are runs of bytes other than ASCII white space. Each word covered by a
    window of ``window`` words that also starts elsewhere, in the same or
    another row, is removed; windows are judged on the input. Repeated rows are
    repeats of each other. Null texts have no words; texts shorter than the
    window keep all; an empty table gives no rows; texts are read whole, very long
    ones hashed in blocks.
    ``kept_text``: the text itself where nothing is removed (null stays null),
    else the kept words joined by one space.
    """
    size = text_bytes(docs, text_col)
    small_batches(docs.sparkSession)
    least = partitions(docs.sparkSession)
    buckets, dests = max(least, -(-size // BUCKET_BYTES)), max(least, -(-size // GROUP_BYTES))
    text = F.col(text_col).cast("binary")
    keys = [F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(text, F.col(id_col), F.lit(1)).alias("k2")]
    keyed = docs.select(*keys, F.struct(*(carried or [F.col(id_col)])).alias("row"), text.alias("text"))
    keyed = keyed.withColumn("dest", (F.col("k1").bitwiseXOR(F.col("k2")).bitwiseAND(F.lit(0x7FFFFFFF)) % dests).cast("int"))
    small = squeezed(keyed)
    schema = T.StructType([keyed.schema["row"], *T._parse_datatype_string("n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")).fields])

    def remove(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts, hit, first = _ordered(texts), _found(found), 0
        n_words, n_removed, sha, kept = [], [], [], []
        for data in unsqueezed(texts["text"]).to_pylist():
            words = (data or b"").split()
            n_words.append(len(words))
            lo, hi = np.searchsorted(hit, [first, first + len(words)])
            starts, removed = hit[lo:hi] - first, 0
            first += len(words)
            if hi > lo:
                edge = np.zeros(len(words) + 1, np.int64)
                edge[starts] += 1
                edge[starts + window] -= 1
                keep = edge.cumsum()[:-1] == 0
                removed = int(len(words) - keep.sum())
                words = [words[j] for j in np.flatnonzero(keep)]
            joined = b" ".join(words)
            n_removed.append(removed)
            sha.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                kept.append(None if data is None else (joined if removed else data).decode())
        out = [texts["row"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
        return pa.table(out + [pa.array(kept, pa.string())] * with_text, names=schema.names)

    found = _repeated(small, window, buckets, dests)
    dealt = [x.repartitionById(dests, F.col("dest")).groupBy("dest") for x in (small, found)]
    out = dealt[0].cogroup(dealt[1]).applyInArrow(remove, schema)
    return out.select("row.*", *schema.names[1:])


def without_repeats(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, with repeated spans taken out of their texts, as remove_repeats() says."""
    columns, at = keyed_columns(docs, text_col)
    keyed = docs.select(*columns, F.col(id_col).alias("_id"))
    others = [F.col(f"_c{i}") for i in range(len(columns)) if i != at]
    out = remove_repeats(keyed, window=window, with_text=True, id_col="_id", text_col=f"_c{at}", carried=others)
    return renamed(out.withColumnRenamed("kept_text", f"_c{at}"), docs.columns)
