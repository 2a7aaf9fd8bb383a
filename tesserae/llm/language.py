"""Operator 7: language identification by nearest centroids.

A text's letters, lower-cased and cut into words, give hashed character n-grams.
Their TF-IDF vector, normalised, is compared by cosine with several centroids
for each language, found by spherical k-means over training vectors. A text whose
nearest centroid is farther than that language's own texts ever are is rejected.

Document frequencies are those of all training texts. Centroids and the limits of
rejection are fitted, a task for each language, to at most ``per_language`` texts
of it (those of the least hash), a documented bound on a classifier's sample;
every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import keyed_columns, renamed, small_batches, tidy
from tesserae.llm.wordhash import mix

BITS = 14
ORDERS = (1, 2, 3)
#: Characters of one text hashed at once; longer texts are taken in pieces that overlap by the longest n-gram.
PIECE = 1 << 18
#: A text is rejected below this share of the cosine that all but a twentieth of its language's own texts, held back from
#: the centroids, reach. Fewer letters say too little: then, and with a sample too small to learn from, the least cosine is the limit.
LIMIT_SHARE, LIMIT_QUANTILE, FEW_LETTERS, LEAST_SAMPLE, LEAST_COSINE = 0.27, 0.05, 20, 40, 0.05


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


_LETTER = _letters()


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter n-grams, a blank at either end of each word; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    if (codes > 0xFFFF).any():
        letter[codes > 0xFFFF] = [chr(c).isalpha() for c in codes[codes > 0xFFFF].tolist()]
    if not letter.any():
        return None
    blank = np.where(letter, codes, 0x20)
    keep = letter.copy()  # of several other characters in a row, one blank stays
    keep[0] = True
    keep[1:] |= letter[:-1]
    line = np.concatenate([[0x20], blank[keep], [0x20]]).astype(np.uint64)
    total = np.zeros(1 << BITS)
    widest = max(ORDERS)
    for at in range(0, len(line), PIECE):
        part = line[at : at + PIECE + widest - 1]
        gram = np.zeros(len(part), np.uint64)
        for n in range(1, widest + 1):
            m = min(PIECE, len(part) - n + 1)
            if m <= 0:
                break
            gram = gram[:m] * np.uint64(0x110000) + part[n - 1 : n - 1 + m]
            if n in ORDERS:
                total += np.bincount((mix(gram + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    return total


def n_letters(counts: np.ndarray | None) -> float:
    """About how many letters a text has: its n-grams by the number of orders."""
    return 0.0 if counts is None else float(counts.sum()) / len(ORDERS)


@dataclass
class Centroids:
    """``of[i]`` is the language of row i of ``vectors`` (unit length, weighted by ``idf``); ``limits``: each language's least cosine."""

    languages: list[str]
    of: np.ndarray
    vectors: np.ndarray
    idf: np.ndarray
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def nearest(self, counts: np.ndarray) -> tuple[int, float]:
        """(language, cosine) of the nearest centroid; ties go to the first in order of language."""
        used = np.flatnonzero(counts)
        v = np.log1p(counts[used]) * self.idf[used]
        cosine = self.vectors[:, used] @ (v / max(np.linalg.norm(v), 1e-12))
        best = int(np.argmax(cosine))
        return int(self.of[best]), float(cosine[best])


def spherical_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k unit centroids; starts spread out, each at the row farthest from those before. Deterministic."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    centres = x[start].copy()
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, axis=1)
        for j in range(len(centres)):
            if (of == j).any():
                s = x[of == j].sum(axis=0)
                centres[j] = s / max(np.linalg.norm(s), 1e-12)
    return centres


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(texts that each n-gram is in, texts with a letter) over all rows of (text): a task adds up its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if (c := ngram_counts(text.as_py())) is not None:
                    total[:-1] += c > 0
                    total[-1] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["slot", "n"])

    found = rows.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # at most 2^BITS + 1 rows
    total = np.zeros((1 << BITS) + 1)
    total[[r["slot"] for r in found]] = [r["n"] for r in found]
    return total[:-1], int(total[-1])


def fit_languages(docs: DataFrame, *, per_language: int = 400, clusters: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Centroids from labelled texts (other rows with a null label, or without a letter, are left out).

    Each language's sample is fitted in a task of its own; what reaches the driver is
    ``clusters`` vectors of a fixed width and a limit for each language.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text"))
    seen, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + seen)) + 1
    # A share of the hash range that holds twice the sample on average; the least per_language of it are taken.
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.count("*")).alias("share"))
    near = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    chosen = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= per_language)

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        found = [c for t in table["text"] if (c := ngram_counts(t.as_py())) is not None]
        if not found:
            return pa.table([pa.array([], pa.string()), pa.array([], pa.binary()), pa.array([], pa.float64())], names=["lang", "vectors", "limit"])
        x = np.log1p(np.array(found, np.float32)) * idf.astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        limit = LEAST_COSINE
        if len(x) >= LEAST_SAMPLE:
            long = np.array([n_letters(c) >= FEW_LETTERS for c in found])
            held = [(x[i::2][long[i::2]] @ spherical_means(x[1 - i :: 2], clusters).T).max(axis=1) for i in (0, 1)]
            own = np.concatenate(held)
            limit = max(LEAST_COSINE, LIMIT_SHARE * float(np.quantile(own, LIMIT_QUANTILE))) if len(own) else LEAST_COSINE
        means = spherical_means(x, clusters)
        return pa.table([pa.array([key[0].as_py()]), pa.array([means.astype("<f4").tobytes()], pa.binary()), pa.array([limit])], names=["lang", "vectors", "limit"])

    found = sorted(chosen.select("lang", "r", "text").groupBy("lang").applyInArrow(fit, "lang string, vectors binary, limit double").collect(), key=lambda r: r["lang"])
    parts = [np.frombuffer(bytes(r["vectors"]), "<f4").reshape(-1, 1 << BITS).astype(float) for r in found]
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return Centroids([r["lang"] for r in found], of, np.concatenate(parts) if parts else np.zeros((0, 1 << BITS)), idf, np.array([r["limit"] for r in found]))


def _scored(rows: DataFrame, at: int, model: Centroids) -> DataFrame:
    """The rows, the text at place ``at`` among the columns, with lang_pred, score and rejected."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("lang_pred string, score double, rejected boolean").fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            lang, cosine, rejected = [], [], []
            for text in batch.column(at):
                counts = ngram_counts(text.as_py())
                best, c = m.nearest(counts) if counts is not None and len(m.of) else (None, 0.0)
                lang.append("und" if best is None else m.languages[best])
                cosine.append(min(1.0, max(0.0, c)))
                rejected.append(counts is None or (best is not None and c < (m.limits[best] if n_letters(counts) >= FEW_LETTERS else LEAST_COSINE)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(cosine, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)
        tidy()

    return rows.mapInArrow(score, schema)


def identify_language(docs: DataFrame, model: Centroids, *, text_col: str = "text", carried: list[Column] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(carried columns, by default the id; lang_pred, score, rejected) for each row.

    ``lang_pred`` is the nearest centroid's language, or ``und`` for a text that is
    null or has no letter (and where nothing was learned). ``score`` is the cosine,
    clipped to 0..1; 0 for ``und``. ``rejected``: no letter, or a cosine below the
    language's learned limit (with fewer than FEW_LETTERS letters, below
    LEAST_COSINE), as of a text in a language never seen; where nothing was learned
    no distance is known, and none is rejected by it. Equal cosines go to the first language in order. Repeated
    rows each give a row; empty tables none; texts are taken whole, in pieces.
    """
    carried = carried or [F.col(id_col)]
    rows = docs.select(*(c.alias(f"_c{i}") for i, c in enumerate(carried)), F.col(text_col).alias("_text"))
    names = docs.select(*carried).columns
    found = _scored(rows, len(carried), model)
    return found.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)), "lang_pred", "score", "rejected")


def with_known_language(docs: DataFrame, model: Centroids, *, text_col: str = "text") -> DataFrame:
    """The rows, all columns, that identify_language() does not reject."""
    columns, at = keyed_columns(docs, text_col)
    return renamed(_scored(docs.select(*columns), at, model).where("NOT rejected"), docs.columns)
