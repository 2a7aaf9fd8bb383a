"""Operator 4: benchmark decontamination by a broadcast hash set of n-grams.

The stated benchmark items become windows of ``n`` words (an item of fewer words
is one window). A block of windows of bounded size is broadcast as a hash set;
documents are scanned by rolling hashes, hits are verified word for word. Items
beyond one block are scanned for in further passes, one block each, so what is
broadcast at once never grows with the benchmark; a very long item goes in pieces
that overlap by a window less one word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import keyed_columns, renamed, small_batches, tidy, written
from tesserae.llm.wordhash import LOWER, Words, hash_words, text_chunks

#: Bytes that are not part of a word (digits, letters and all non-ASCII bytes are), and lower case for A-Z.
TO_WORDS = bytes(0x20 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
NOT_WORD = np.frombuffer(TO_WORDS, np.uint8) == 0x20
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_BYTES, PIECE_WORDS = 8 << 20, 100_000


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and takes the runs of word bytes."""
    return text.translate(TO_WORDS).split()


def item_pieces(items: DataFrame, n: int) -> DataFrame:
    """(item, words) of (item, words): lower-cased words with single blanks, in pieces that hold every window once."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                for at in range(0, max(1, len(words) - n + 1) if words else 0, PIECE_WORDS):
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()], pa.string()), pa.array([b" ".join(words[at : at + PIECE_WORDS + n - 1])], pa.binary())], names=["item", "words"])

    return items.mapInArrow(pieces, "item string, words binary")


class Windows:
    """The windows of some items, in arrays only: per length sorted hashes, where each window is in the items' bytes, and
    the items that hold it. ``items`` are (id, lower-cased words with single blanks)."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        item = np.array([number[i] for i, _ in items], np.int32)
        self.data = b"".join(t for _, t in items)
        words = hash_words(np.frombuffer(self.data, np.uint8), np.cumsum([0, *(len(t) for _, t in items)]))
        size, text = words.counts, words.text_of()
        self.by_length = {}
        for length in sorted({n, *size[size < n].tolist()} - {0}):
            at, grams = words.ngrams(length)
            mine = size[text[at]] >= n if length == n else size[text[at]] == length
            at, grams = at[mine], grams[mine]
            if len(at):
                order = np.argsort(grams, kind="stable")
                self.by_length[length] = self._table(grams[order], words.starts[at[order]], words.ends[at[order] + length - 1], item[text[at[order]]])

    def _table(self, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray, item: np.ndarray) -> tuple:
        new = np.concatenate([[True], grams[1:] != grams[:-1]])
        first = np.flatnonzero(new)[new.cumsum() - 1]
        # Equal hashes are told apart by their words.
        for i in np.flatnonzero(~new):
            new[i] = self.data[starts[i] : ends[i]] != self.data[starts[first[i]] : ends[first[i]]]
        at = np.flatnonzero(new)
        bits = max(12, int(8 * len(at)).bit_length())
        maybe = np.zeros(1 << bits, bool)
        maybe[(grams & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        return grams[at], starts[at], ends[at], np.append(at, len(grams)), item, maybe

    def hits(self, words: Words, window) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, word after the last, items) of each window found; ``window(i, length)``: the words from place i on."""
        for length, (grams, starts, ends, cuts, item, maybe) in self.by_length.items():
            at, found = words.ngrams(length)
            near = np.flatnonzero(maybe[(found & np.uint64(len(maybe) - 1)).astype(np.int64)])
            at, found = at[near], found[near]
            k = np.searchsorted(grams, found)
            same = grams[np.minimum(k, len(grams) - 1)] == found
            for i, j in zip(at[same].tolist(), k[same].tolist(), strict=True):
                said, value = window(i, length), grams[j]
                while j < len(grams) and grams[j] == value:
                    if self.data[starts[j] : ends[j]] == said:
                        yield i, i + length, item[cuts[j] : cuts[j + 1]].tolist()
                        break
                    j += 1


_TAIL = "n_words long, spans array<struct<first:bigint,after:bigint>>, items array<string>"


def _scan(rows: DataFrame, at_text: int, sent, with_text: bool = True) -> DataFrame:
    """Appends n_words, spans (merged runs of hit words) and items to the rows' columns; the text is at place ``at_text`` of
    them, as text or bytes, and goes unless wanted. ``sent``: Windows, broadcast."""
    kept = [f for i, f in enumerate(rows.schema.fields) if with_text or i != at_text]
    schema = T.StructType([*kept, *T._parse_datatype_string(_TAIL).fields])
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            column = batch.column(at_text)
            for a, b, data, offsets in text_chunks(column.cast(pa.binary())):
                words = hash_words(data, offsets, LOWER, NOT_WORD)
                text, part = words.text_of(), data[offsets[0] : offsets[-1]]
                whole: dict[int, list[bytes]] = {}

                def window(i: int, length: int, words=words, text=text, part=part, offsets=offsets, whole=whole) -> bytes:
                    t = int(text[i])
                    if t not in whole:
                        whole.clear()  # hits come text by text
                        whole[t] = words_of(part[offsets[t] - offsets[0] : offsets[t + 1] - offsets[0]].tobytes())
                    i -= int(words.bounds[t])
                    return b" ".join(whole[t][i : i + length])

                covered, seen = np.zeros(len(words.hashes) + 1, np.int64), defaultdict(set)
                for i, j, k in w.hits(words, window):
                    covered[i] += 1
                    covered[j] -= 1
                    seen[int(text[i])].update(k)
                hit = covered.cumsum()[:-1] > 0
                spans, items = [[] for _ in range(b - a)], [[] for _ in range(b - a)]
                for t, k in seen.items():
                    own = np.concatenate([[False], hit[words.bounds[t] : words.bounds[t + 1]], [False]])
                    edges = np.flatnonzero(own[1:] != own[:-1])
                    spans[t] = [{"first": int(x), "after": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)]
                    items[t] = sorted(w.items[x] for x in k)
                own = [c.slice(a, b - a) for i, c in enumerate(batch.columns) if with_text or i != at_text]
                yield pa.RecordBatch.from_arrays([*own, pa.array(words.counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))], names=schema.names)
        tidy()

    return rows.mapInArrow(scan, schema)


def _unite(spans):
    """Sorted, merged spans of a list of spans."""
    return F.aggregate(
        F.array_sort(spans),
        F.lit(None).cast("array<struct<first:bigint,after:bigint>>"),
        lambda out, s: F.when(out.isNull(), F.array(s)).otherwise(
            F.when(
                s["first"] <= F.element_at(out, -1)["after"],
                F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(F.element_at(out, -1)["after"], s["after"]).alias("after")))),
            ).otherwise(F.concat(out, F.array(s)))
        ),
    )


def _found(rows: DataFrame, at_text: int, items: DataFrame, n: int, block_bytes: int, item_id_col: str, item_text_col: str, with_text: bool) -> DataFrame:
    """The rows' columns with n_words, spans and items (sorted, each once)."""
    spark = rows.sparkSession
    small_batches(spark)
    known = items.select(F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("words")).where("item is not null and words is not null")
    known = written(item_pieces(known, n), "benchmark")
    size = known.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))

    def block(b: int):
        # About block_bytes: the pieces are dealt evenly.
        few = sorted((r["item"], bytes(r["words"])) for r in known.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).collect())
        return spark.sparkContext.broadcast(Windows(few, n))

    if blocks == 1:
        return _scan(rows, at_text, block(0), with_text)
    # What a text holds does not depend on its row, so the hits in it, which alone are written, meet its rows by its hash.
    text = F.col(rows.columns[at_text])
    texts, hits = rows.select(F.md5(text.cast("binary")).alias("_text_key"), text.cast("binary").alias("_text")), []
    for b in range(blocks):
        sent = block(b)
        hits.append(written(_scan(texts, 1, sent, False).where("size(spans) > 0").select("_text_key", "spans", "items").distinct(), "decontaminate"))
        sent.destroy()
    for h in hits[1:]:
        hits[0] = hits[0].unionByName(h)
    of = hits[0].groupBy("_text_key").agg(_unite(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    keyed = rows.withColumn("n_words", F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")).withColumn("_text_key", F.md5(text.cast("binary")))
    fields = T._parse_datatype_string(_TAIL).fields[1:]
    out = keyed.join(of, "_text_key", "left").select(*rows.columns, "n_words", *(F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name) for f in fields))
    return out if with_text else out.drop(rows.columns[at_text])


def _hit_words():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["after"] - s["first"])


def _contaminated(share: int):
    return (_hit_words() > 0) & (_hit_words() * share >= F.col("n_words"))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    n: int = 13,
    share: int = 20,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items) for each document.

    Words are runs of ASCII letters and digits and of all other than ASCII
    characters, with A-Z lowered. ``spans`` are the runs of hit words (first word,
    word after the last), ``items`` the ids, as sorted text, of the items with a
    window in the document. A document is contaminated if at least one in ``share``
    of its words is hit. Null or empty texts, of documents or items, have no words
    and no windows; repeated documents each give a row; of repeated items each id
    counts once. Empty tables are fine on either side. Texts are read whole, very long
    ones hashed in blocks; very long items go in overlapping pieces.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    found = _found(rows, 1, items, n, block_bytes, item_id_col, item_text_col, False)
    digest = [_hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")]
    return found.select(id_col, "n_words", *digest, _contaminated(share).alias("contaminated"), "spans", "items")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    remove: str = "documents",
    n: int = 13,
    share: int = 20,
    block_bytes: int = BLOCK_BYTES,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The documents, all columns, without the contaminated ones (``remove="documents"``) or with the
    hit words taken out of contaminated texts (``remove="spans"``). Clean documents stay as they are, nulls among them,
    and so do all columns, whatever their names."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is documents or spans, not {remove}")
    columns, at = keyed_columns(docs, text_col)
    found = _found(docs.select(*columns), at, items, n, block_bytes, item_id_col, item_text_col, True)
    if remove == "documents":
        return renamed(found.where(~_contaminated(share)), docs.columns)

    @F.pandas_udf("string")
    def strip(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, [(s["first"], s["after"]) for s in (x if x is not None else [])]) for t, x in zip(text, spans, strict=True)])

    spans = F.when(_contaminated(share), F.col("spans"))
    return renamed(found.withColumn(f"_c{at}", strip(F.col(f"_c{at}"), spans)), docs.columns)


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text with the bytes of the hit words' runs taken out; all else stays as it is."""
    if not text or not spans:
        return text
    data = text.encode()
    word = np.frombuffer(data.translate(TO_WORDS), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, data[at:]]).decode()
