"""Operator 10: a quality classifier on pooled random-indexing word vectors.

Each word has a random index vector, sparse with signs, that follows from its
hash. A word's vector is the sum of its neighbours' index vectors over all
documents; words share a fixed number of rows by hash, so the table that is
broadcast has the same size for any corpus. A document's features are the mean
and the spread of its words' vectors and the mean of its marks' vectors (runs of
punctuation are words of a second kind). A network of two layers, in numpy, is
fitted on a bounded sample of labelled rows and its temperature on a part of the
sample that training did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import is_held_out, small_batches
from tesserae.llm.samples import labelled_sample
from tesserae.llm.wordhash import Words, hash_words, mix, text_chunks

ROW_BITS, DIMS, NONZERO, WINDOW = 14, 64, 2, 2
ROWS, SLICES, FAN_IN = 1 << ROW_BITS, 16, 64
_BYTES = np.arange(256)
#: Separators of the stream of marks: all but ASCII punctuation.
NOT_MARK = ~((_BYTES >= 0x21) & (_BYTES <= 0x7E)) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))


def streams(data: np.ndarray, offsets: np.ndarray) -> Iterator[Words]:
    """The texts' words, then their marks."""
    words = hash_words(data, offsets)
    yield words
    marks = hash_words(data, offsets, separator=NOT_MARK)
    yield Words(mix(marks.hashes + np.uint64(1)), marks.bounds)


def rows_of(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - ROW_BITS)).astype(np.int64)


def add_contexts(words: Words, table: np.ndarray) -> None:
    """Adds the index vectors of up to WINDOW neighbours on either side to each word's row."""
    row, text = rows_of(words), words.text_of()
    for k in range(NONZERO):
        x = mix(words.hashes ^ np.uint64(0xA5A5A5A5 + k))
        place, sign = (x % np.uint64(DIMS)).astype(np.int64), np.where(x >> np.uint64(63), 1.0, -1.0)
        for d in range(1, WINDOW + 1):
            near = np.flatnonzero(text[d:] == text[:-d])
            for a, b in ((near, near + d), (near + d, near)):
                table += np.bincount(row[a] * DIMS + place[b], weights=sign[b], minlength=ROWS * DIMS)


def word_vectors(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """The table of word vectors, ROWS x DIMS, each row of unit length, from all texts.

    A task sums its own texts' contexts; the tasks' tables, in slices, are summed
    over groups of FAN_IN tasks at a time, so no task reads more than that many.
    """
    small_batches(docs.sparkSession)
    schema = T._parse_datatype_string("part int, slice int, level int, sums binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.zeros(ROWS * DIMS)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                for words in streams(data, offsets):
                    add_contexts(words, table)
        if table.any():
            parts = [x.astype("<f4").tobytes() for x in table.reshape(SLICES, -1)]
            columns = [pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array([0] * SLICES, pa.int32()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * DIMS // SLICES)
        for batch in batches:
            for part in batch.column(3):
                total += np.frombuffer(part.as_buffer(), "<f4")
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    sums, tasks = texts.mapInArrow(count, schema), texts.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        sums = sums.withColumn("part", F.col("part") % tasks).groupBy("part", "slice").applyInArrow(add, schema)
    table = np.zeros((SLICES, ROWS * DIMS // SLICES))
    for r in sums.select("slice", "sums").collect():
        table[r["slice"]] += np.frombuffer(bytes(r["sums"]), "<f4")
    table = table.reshape(ROWS, DIMS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row of 3 * DIMS features for each text; zeros where there is nothing to pool."""
    out = np.zeros((len(offsets) - 1, 3 * DIMS), np.float32)
    for k, words in enumerate(streams(data, offsets)):
        full = np.flatnonzero(words.counts)
        row = rows_of(words)
        # Texts in runs of about 100,000 words, to bound the memory of their vectors.
        at = 0
        while at < len(full):
            to = max(at + 1, int(np.searchsorted(words.bounds[full], words.bounds[full[at]] + 100_000)))
            own = full[at:to]
            x = vectors[row[words.bounds[own[0]] : words.bounds[own[-1] + 1]]]
            starts = words.bounds[own] - words.bounds[own[0]]
            n = words.counts[own][:, None]
            mean = np.add.reduceat(x, starts, axis=0) / n
            if k:
                out[own, 2 * DIMS :] = mean
            else:
                out[own, :DIMS] = mean
                out[own, DIMS : 2 * DIMS] = np.sqrt(np.maximum(np.add.reduceat(x * x, starts, axis=0) / n - mean**2, 0))
            at = to
    return out


@dataclass
class Network:
    """Two layers on standardised features; ``temperature`` divides the output before the sigmoid."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    return float(np.average(np.logaddexp(0, logits) - y * logits, weights=weights))


def fit_network(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, *, hidden: int = 32, epochs: int = 60, decay: float = 1e-3, seed: int = 7) -> Network:
    """Adam on the logistic loss over four fifths of the rows; a tenth says when to stop, and on the last tenth, which
    neither has seen, the temperature minimises the loss.
    ``weights`` say how many rows each row stands for (one each by default).
    With no rows, or one label only, the network gives that label's share (one half without rows)."""
    width = x.shape[1]
    c = np.ones(len(y)) if weights is None else weights / weights.mean() if len(y) else weights
    net = Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if len(set(y.tolist())) < 2:
        net.b2 = 0.0 if not len(y) else (5.0 if y[0] else -5.0)
        return net
    r = np.random.default_rng(seed)
    order = r.permutation(len(y))
    check, unseen, train = np.split(order, [len(y) // 10, len(y) // 5])
    net.mean = np.average(x[train], axis=0, weights=c[train])
    net.scale = np.sqrt(np.average((x[train] - net.mean) ** 2, axis=0, weights=c[train])) + 1e-3
    net.w1, net.w2 = r.normal(0, width**-0.5, (width, hidden)), r.normal(0, hidden**-0.5, hidden)
    z = (x - net.mean) / net.scale
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    best, kept = np.inf, [v.copy() for v in values]
    for _ in range(epochs):
        for at in range(0, len(train), 128):
            i = train[r.integers(0, len(train), min(128, len(train)))]
            h = np.tanh(z[i] @ values[0] + values[1])
            g = (1 / (1 + np.exp(-(h @ values[2] + values[3]))) - y[i]) * c[i] / len(i)
            gh = np.outer(g, values[2]) * (1 - h * h)
            grads = [z[i].T @ gh + decay * values[0], gh.sum(axis=0), h.T @ g + decay * values[2], np.array([g.sum()])]
            step += 1
            for k, d in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                values[k] -= 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        rows = check if len(check) else train
        now = _loss(np.tanh(z[rows] @ values[0] + values[1]) @ values[2] + values[3], y[rows], c[rows])
        if now < best:
            best, kept = now, [v.copy() for v in values]
    net.w1, net.b1, net.w2, net.b2 = kept[0], kept[1], kept[2], float(kept[3][0])
    rows = unseen if len(unseen) else train
    logits = net.logits(x[rows])
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: _loss(logits / t, y[rows], c[rows])))
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = 6000, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Word vectors from all texts; the network from at most ``per_class`` labelled training rows of each label."""
    vectors = word_vectors(docs, text_col=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = labelled_sample(docs, labels, label, per_class=per_class, modulus=modulus, remainder=remainder, id_col=id_col, text_col=text_col)
    rows = sample.select(F.col("id").cast("string").alias("id"), "y", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "weight")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([pooled(data, offsets, sent.value) for _, _, data, offsets in text_chunks(batch.column(2))] or [np.zeros((0, 3 * DIMS), np.float32)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(3)], names=["id", "y", "x", "weight"])

    found = sorted(rows.mapInArrow(features, "id string, y int, x binary, weight double").collect(), key=lambda r: (r["id"], r["y"], bytes(r["x"])))
    # The sample takes as many of either label as it can; the weights restore the shares.
    x = np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in found], float).reshape(-1, 3 * DIMS)
    return QualityModel(vectors, fit_network(x, np.array([r["y"] for r in found], float), np.array([r["weight"] for r in found], float)))


def score_quality(docs: DataFrame, model: QualityModel, *, threshold: float = 0.7, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", carried: list[Column] | None = None) -> DataFrame:
    """(id, held_out, score, predicted) for each row; null and empty texts score as the network says of no words.

    Texts are taken whole; repeated rows each give a row, an empty table none; a null id is not held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    first = carried or [F.col(id_col), is_held_out(F.col(id_col), modulus, remainder).alias("held_out")]
    rows = docs.select(*first, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            p = [m.network.probability(pooled(data, offsets, m.vectors)) for _, _, data, offsets in text_chunks(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(p) if p else np.zeros(0), pa.float64())], names=schema.names)

    return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
