"""Operator 2: vector best-fit packing of tokenised documents into sequences.

Documents become pieces of at most ``max_tokens`` tokens. Pieces are dealt by a
hash into groups of a bounded number; within a group the pieces, longest first,
go to the open sequence that fits best in three capacities at once: tokens left,
documents left and attention cost (sum of squared lengths) left.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import cut, small_batches
from tesserae.llm.wordbpe import IdReader, reader

PIECE_FIELDS = "piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, vocabulary: bytes, *, end_id: int = 1, max_tokens: int = 4096, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document.

    A document's ids are its tokens and then ``end_id``; null and empty texts
    have that one id. Only documents of more than ``max_tokens`` ids are cut,
    after every ``max_tokens``. ``ids`` (on request) holds the piece's ids.
    """
    small_batches(docs.sparkSession)
    key = hashlib.sha256(vocabulary).hexdigest()
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema[id_col], *T._parse_datatype_string(PIECE_FIELDS + (", ids array<int>" if with_ids else "")).fields])
    tail = end_id.to_bytes(4, "little")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, width = reader(IdReader, key, spec.value), 4 * max_tokens
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = of.read(text) + tail
                for k, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, np.uint32).astype(np.int32))
            out = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(cut_up, schema)


def best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece of one group.

    Each piece asks for (tokens, documents, attention cost) = (n, 1, n * n).
    Longest first, it goes to the feasible open sequence with the smallest
    weighted residual after the placement (``rule="norm"``) or the largest
    weighted dot product of its needs with the residual (``rule="dot"``), both
    measured in shares of the capacities; ties go to the older sequence. If
    none is feasible a new sequence opens. A piece that alone is beyond the
    document or attention capacity still gets a sequence of its own.
    """
    n = len(lengths)
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], axis=1)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((max(16, n // 4), 3))  # of the open sequences, in order of opening
    names = np.zeros(len(left), np.int64)
    open_, made = 0, 0
    used: list[int] = []
    scale = weights / capacity**2
    smallest = need.min(axis=0) if n else capacity
    for i in np.argsort(-lengths, kind="stable"):
        free = left[:open_]
        fits = np.flatnonzero((free >= need[i]).all(axis=1))
        if len(fits):
            rest = free[fits]
            score = (rest - need[i]) ** 2 @ scale if rule == "norm" else -(rest @ (need[i] * scale))
            at = int(fits[np.argmin(score)])
        else:
            if open_ == len(left):
                left, names = np.concatenate([left, np.zeros_like(left)]), np.concatenate([names, np.zeros_like(names)])
            left[open_], names[open_] = capacity, made
            used.append(0)
            at, made, open_ = open_, made + 1, open_ + 1
        sequence[i], offset[i] = names[at], used[names[at]]
        used[names[at]] += int(lengths[i])
        left[at] -= need[i]
        if (left[at] < smallest).any():  # nothing fits any more
            left[at : open_ - 1], names[at : open_ - 1] = left[at + 1 : open_].copy(), names[at + 1 : open_].copy()
            open_ -= 1
    return sequence, offset


def pack(
    docs: DataFrame,
    vocabulary: bytes,
    *,
    max_tokens: int = 4096,
    max_docs: int | None = None,
    max_attention: float | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    group_pieces: int = 8192,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    ``max_docs`` and ``max_attention`` limit pieces and the sum of squared
    lengths in one sequence; by default they are what ``max_tokens`` implies.
    Groups hold about ``group_pieces`` pieces at every input size, so a task's
    memory does not grow with the input, and the loss against one single group
    is part of one sequence a group. Null texts are empty (one id). Repeated
    rows are packed each for itself; an empty table gives no row. ``offset`` has
    no gaps within a ``sequence_id``. Very long texts are cut into pieces one by one.
    """
    capacity = np.array([max_tokens, max_docs or max_tokens, max_attention or float(max_tokens) ** 2], float)
    pieces = cut(token_pieces(docs, vocabulary, end_id=end_id, max_tokens=max_tokens, id_col=id_col, text_col=text_col))
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = T.StructType([*pieces.schema.fields, *T._parse_datatype_string("sequence_id long, offset long").fields])

    def place(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop(columns="_group").sort_values([id_col, "piece", "ids_crc32"], kind="stable", na_position="first")
        sequence, offset = best_fit(group["length"].to_numpy(), capacity, np.array(weights), rule)
        return group.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    # The pieces are checkpointed, so their numbers stay: they deal even repeated rows evenly.
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(place, schema)
