"""Operator 5: language-model scoring by prediction by partial matching.

The model is a trie of byte contexts up to ORDER bytes, counted over the training
texts. A byte is coded in its longest known context; where it is new there, an
escape is coded (method D: half a count for each distinct symbol) and the next
shorter context codes it with the symbols excluded that the longer one had.
Below the empty context all remaining bytes are equally likely.

The model is static, so a code length depends on the last ORDER + 1 bytes only.
All sums that exclusion needs are sums over one context's symbols, so they are
tabulated for each context and whole batches of texts are scored by table
look-up. The trie is broadcast in blocks of a bounded number of nodes; each
block holds whole sub-tries (by a context's last two bytes) and scores the
positions that are its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import is_held_out, written
from tesserae.llm.unigram import unigram_scores
from tesserae.llm.wordhash import LOWER, SPACE, text_chunks

ORDER = 5
#: Not a byte of any UTF-8 text: stands before a text, and once after it as a symbol to be coded.
END = 0xFF
BLOCK_GRAMS = 3_000_000
CHUNK = 1 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams, symbols of each text): the last ORDER + 1 bytes, as numbers, at each symbol of the texts.

    A text is its words, with A-Z lowered, with one blank between, then END.
    """
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n, texts = len(data), len(offsets) - 1
    inside = ~SPACE[data]
    edges = offsets[:-1][offsets[:-1] < n]
    after = np.concatenate([inside[1:], [False]]) if n else inside
    after[edges - 1] = False  # the last entry, for edge 0, is False already
    # A blank after each word that another one follows in its text.
    ends = np.flatnonzero(inside & ~after)
    text_of_end = np.searchsorted(offsets, ends, "right") - 1
    more = np.flatnonzero(text_of_end[:-1] == text_of_end[1:]) if len(ends) else ends
    keep = inside.copy()
    keep[ends[more] + 1] = True
    bytes_ = np.where(inside, LOWER[data], 0x20).astype(np.uint8)[keep]
    lengths = np.diff(np.concatenate([[0], keep.cumsum()])[offsets])
    text_of = np.repeat(np.arange(texts), lengths)
    line = np.full(len(bytes_) + ORDER * (texts + 1), END, np.uint8)
    line[ORDER + np.arange(len(bytes_)) + ORDER * text_of] = bytes_
    symbols = lengths + 1
    first = ORDER + np.concatenate([[0], (lengths[:-1] + ORDER).cumsum()]) if texts else np.zeros(0, np.int64)
    at = np.repeat(first - np.concatenate([[0], symbols[:-1].cumsum()]), symbols) + np.arange(symbols.sum()) if texts else first
    grams = np.zeros(len(line) - ORDER, np.uint64)
    for j in range(ORDER + 1):
        grams = (grams << np.uint64(8)) | line[j : len(line) - ORDER + j]
    return grams[at.astype(np.int64) - ORDER], symbols


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n) over all rows of (text binary): the trie's deepest level, from which the others follow."""
    schema = T._parse_datatype_string("gram long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            g, n = (np.concatenate(x) for x in zip(*kept, strict=True))
            unique, inverse = np.unique(g, return_inverse=True)
            return unique, np.bincount(inverse, weights=n).astype(np.int64)

        def out(part) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part[0].astype(np.int64)), pa.array(part[1])], names=schema.names)

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), CHUNK):
                kept.append(np.unique(stream(data, offsets)[0], return_counts=True))
                held += len(kept[-1][0])
                if held > 1_500_000:
                    kept = [merged()]
                    held = len(kept[0][0])
                    if held > 1_000_000:
                        yield out(kept[0])
                        kept, held = [], 0
        if kept:
            yield out(merged())

    return texts.mapInArrow(count, schema).groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """A depth of the trie: grams (context and symbol) with counts, and each context's figures.

    total, distinct: counts and symbols of the context. below, fresh: counts and symbols of the next
    shorter context without the symbols that this one has.
    """

    grams: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    below: np.ndarray | None = None
    fresh: np.ndarray | None = None


def _level(grams: np.ndarray, n: np.ndarray, shorter: Level | None, length: int) -> Level:
    grams, inverse = np.unique(grams, return_inverse=True)
    n = np.bincount(inverse, weights=n, minlength=len(grams)).astype(np.int64)
    context = grams >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(grams) else np.zeros(0, np.int64)
    sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)
    out = Level(grams, n, context[first], sums(n), np.diff(first, append=len(grams)).astype(np.int16))
    if shorter is not None:
        low = np.uint64((1 << 8 * length) - 1)
        there = np.searchsorted(shorter.grams, grams & low)
        parent = np.searchsorted(shorter.contexts, out.contexts & (low >> np.uint64(8)))
        out.below = shorter.total[parent] - sums(shorter.n[there])
        out.fresh = (shorter.distinct[parent] - out.distinct).astype(np.int16)
    return out


class Trie:
    """One block of the model: log10 probabilities of symbols after contexts."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], block: int = 0, blocks: int = 1):
        """grams: of the block, ORDER + 1 bytes each; low: two-byte grams with their counts in the whole model."""
        self.block, self.blocks = block, blocks
        zero = _level(low[0] & np.uint64(0xFF), low[1], None, 0)
        self.levels = [zero, _level(low[0], low[1], zero, 1)]
        for j in range(2, ORDER + 1):
            self.levels.append(_level(grams & np.uint64((1 << 8 * (j + 1)) - 1), n, self.levels[-1], j))
        self.keys = self.values = None

    def __getstate__(self) -> dict:
        # The table of the deepest level is made where it is used.
        return self.__dict__ | {"keys": None, "values": None}

    def _fill(self) -> None:
        top = self.levels[-1]
        value = np.log10(2 * top.n - 1) - np.log10(2 * top.total[np.searchsorted(top.contexts, top.grams >> np.uint64(8))]) if len(top.n) else np.zeros(0)
        bits = max(4, int(len(top.n) * 4 // 3 + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.zeros(1 << bits)
        left, slot = np.arange(len(top.n)), self._slot(top.grams)
        while len(left):
            free = self.keys[slot] == _EMPTY
            taken, who = np.unique(slot[free], return_index=True)
            who = np.flatnonzero(free)[who]
            self.keys[taken], self.values[taken] = top.grams[left[who]], value[left[who]]
            rest = np.ones(len(left), bool)
            rest[who] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask
        # Grams of the deepest level are found in the table, so what escapes has none there.
        top.grams, top.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def own(self, grams: np.ndarray) -> np.ndarray:
        return ((grams >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(self.blocks) == self.block

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """The log10 probability of each gram's last byte after the others."""
        if self.keys is None:
            self._fill()
        slot = self._slot(grams)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != grams)
        left, slot = miss, slot[miss]
        unseen = []
        while len(left):
            empty = self.keys[slot] == _EMPTY
            unseen.append(left[empty])
            left, slot = left[~empty], (slot[~empty] + 1) & self.mask
            hit = self.keys[slot] == grams[left]
            out[left[hit]] = self.values[slot[hit]]
            left, slot = left[~hit], slot[~hit]
        if unseen and len(rest := np.concatenate(unseen)):
            kinds, inverse = np.unique(grams[rest], return_inverse=True)
            out[rest] = self._escaping(kinds)[inverse]
        return out

    def _escaping(self, grams: np.ndarray) -> np.ndarray:
        """As log10, level by level, for any grams."""
        score, done = np.zeros(len(grams)), np.zeros(len(grams), bool)
        # What the longer context leaves of this one: counts and symbols; -1 where the longer one is unknown.
        below, fresh = np.full(len(grams), -1), np.full(len(grams), -1)
        for j in range(ORDER, -1, -1):
            level = self.levels[j]
            g = grams & np.uint64((1 << 8 * (j + 1)) - 1)
            if not len(level.contexts):
                continue
            c = np.minimum(np.searchsorted(level.contexts, g >> np.uint64(8)), len(level.contexts) - 1)
            known = ~done & (level.contexts[c] == g >> np.uint64(8))
            total = np.where(below < 0, level.total[c], below)
            distinct = np.where(fresh < 0, level.distinct[c], fresh)
            here = np.zeros(len(grams), bool)
            if len(level.grams):
                i = np.minimum(np.searchsorted(level.grams, g), len(level.grams) - 1)
                here = known & (level.grams[i] == g) & (total > 0)
                score[here] += np.log10(2 * level.n[i[here]] - 1) - np.log10(2 * total[here])
            escape = known & ~here & (total > 0)
            score[escape] += np.log10(distinct[escape]) - np.log10(2 * total[escape])
            done |= here
            if j:
                below, fresh = np.where(known, level.below[c], -1), np.where(known, level.fresh[c], -1)
        seen = len(self.levels[0].grams)
        score[~done] -= np.log10(max(256 - seen, 1))
        return score


def _sums(trie: Trie, texts: pa.Array) -> np.ndarray:
    """Each text's sum over the positions that are the block's own."""
    out = [np.zeros(0)]
    for _, _, data, offsets in text_chunks(texts, CHUNK):
        grams, symbols = stream(data, offsets)
        if trie.blocks == 1:
            value = trie.log10(grams)
        else:
            value, mine = np.zeros(len(grams)), np.flatnonzero(trie.own(grams))
            value[mine] = trie.log10(grams[mine])
        out.append(np.add.reduceat(value, np.concatenate([[0], symbols[:-1].cumsum()])))
    return np.concatenate(out)


def score_texts(docs: DataFrame, *, modulus: int = 7, remainder: int = 2, block_grams: int = BLOCK_GRAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Words lie between ASCII white space, with A-Z lowered; tokens are the words
    and one end. Training texts are those not held out; null ids are training
    texts. ``base_score`` is the unigram score with add-one smoothing; ``score``
    is the trie's log10 probability of the words with single blanks and the end.
    Null and empty texts are one end; repeated rows count and score each; with no
    training text all bytes are equally likely; an empty table gives no rows. Very
    long texts are scored whole, a megabyte at a time.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), is_held_out(F.col(id_col), modulus, remainder).alias("held_out"), text.alias("text"))
    counted = written(count_grams(rows.where("NOT held_out").select("text")), "ppm")
    blocks = max(1, -(-counted.count() // block_grams))
    low = counted.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    low = (low["gram"].to_numpy().astype(np.uint64), low["n"].to_numpy())

    def broadcast(b: int):
        own = counted.where((F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)) % blocks) == b).toArrow()
        return docs.sparkSession.sparkContext.broadcast(Trie(own["gram"].to_numpy().astype(np.uint64), own["n"].to_numpy(), low, b, blocks))

    trie = broadcast(0)
    scored = unigram_scores(rows, lambda texts: _sums(trie.value, texts), blocks > 1)
    for b in range(1, blocks):
        scored = written(scored, "ppm-scored")
        trie.destroy()  # what it scored is written
        trie = broadcast(b)

        def add(batches: Iterator[pa.RecordBatch], trie=trie) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = batch.num_columns - 2
                total = pa.array(batch.column(k).to_numpy() + _sums(trie.value, batch.column(k + 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], total, batch.column(k + 1)], names=batch.schema.names)

        scored = scored.mapInArrow(add, scored.schema)
    return scored.drop("text").withColumnRenamed("id", id_col)
