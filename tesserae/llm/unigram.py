"""Unigram baseline of language-model scoring: word counts of a training part, looked up for every text.

Texts are dealt into groups. A group sends each distinct word's hash once to the
word's bucket, with its count in the group's training texts; the bucket adds the
counts of all groups and answers each with the totals, in the order asked. So
the vocabulary is never in one place, and a frequent word costs a bucket one
entry for each group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import partitions, small_batches, squeezed, text_bytes, unsqueezed, written
from tesserae.llm.wordhash import LOWER, Words, hash_words, text_chunks

GROUP_BYTES, BUCKET_BYTES = 12 << 20, 48 << 20


def _words(texts: pa.Array) -> Words:
    """Lower-cased words between ASCII white space of all texts."""
    parts = [hash_words(data, offsets, LOWER) for _, _, data, offsets in text_chunks(texts)]
    counts = np.concatenate([p.counts for p in parts] or [np.zeros(0, np.int64)])
    return Words(np.concatenate([p.hashes for p in parts] or [np.zeros(0, np.uint64)]), np.concatenate([[0], counts.cumsum()]))


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the hashes by bucket, where each bucket starts)."""
    bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def unigram_scores(rows: DataFrame, also: Callable[[pa.Array], np.ndarray], with_text: bool) -> DataFrame:
    """Appends n_tokens, n_known, train_tokens, base_score and score to rows of (id, held_out, text binary).

    ``score`` is what ``also`` makes of the texts, here because they are at hand. The text stays only if asked for.

    Tokens are a text's words and one end. With c a token's count in the texts
    that are not held out, N all of those and V the distinct ones, ``base_score``
    is the sum of log10((c + 1) / (N + V + 1)).
    """
    size = text_bytes(rows, "text")
    small_batches(rows.sparkSession)
    groups, buckets = max(partitions(rows.sparkSession), -(-size // GROUP_BYTES)), max(8, -(-size // BUCKET_BYTES))
    ends = rows.where("NOT held_out").count()
    dealt = squeezed(rows.select("id", "held_out", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int").alias("grp"), F.coalesce("text", F.lit(b"")).alias("text")))
    asked = T._parse_datatype_string("bucket int, grp int, hashes binary, counts binary")
    answer = T._parse_datatype_string("bucket int, grp int, counts binary, n long, v long")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        words = _words(unsqueezed(table["text"]))
        train = ~table["held_out"].to_numpy().astype(bool)
        hashes, inverse = np.unique(words.hashes, return_inverse=True)
        counts = np.bincount(inverse, weights=np.repeat(train, words.counts), minlength=len(hashes)).astype("<u4")
        order, cuts = _by_bucket(hashes, buckets)
        full = np.flatnonzero(np.diff(cuts))
        parts = [order[cuts[b] : cuts[b + 1]] for b in full]
        columns = [pa.array(full, pa.int32()), pa.array([key[0].as_py()] * len(full), pa.int32()), pa.array([hashes[i].tobytes() for i in parts], pa.binary()), pa.array([counts[i].tobytes() for i in parts], pa.binary())]
        return pa.table(columns, names=asked.names)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        hashes = np.frombuffer(b"".join(rows["hashes"]), "<u8")
        unique, inverse = np.unique(hashes, return_inverse=True)
        total = np.bincount(inverse, weights=np.frombuffer(b"".join(rows["counts"]), "<u4"), minlength=len(unique)).astype("<u8")
        cuts = np.cumsum([0, *(len(h) // 8 for h in rows["hashes"])])
        back = [total[inverse[a:b]].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        b, k = key[0].as_py(), len(back)
        columns = [pa.array([b] * (k + 1), pa.int32()), pa.array([*rows["grp"], -1], pa.int32()), pa.array([*back, b""], pa.binary()), pa.array([0] * k + [int(total.sum())], pa.int64()), pa.array([0] * k + [int((total > 0).sum())], pa.int64())]
        return pa.table(columns, names=answer.names)

    answers = written(dealt.groupBy("grp").applyInArrow(ask, asked).groupBy("bucket").applyInArrow(add, answer), "unigrams")
    n, v = answers.where("grp = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = n + ends, v + (ends > 0)
    schema = T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string("n_tokens long, n_known long, train_tokens long, base_score double, score double" + (", text binary" if with_text else "")).fields])

    def look_up(table: pa.Table, back: pa.Table) -> pa.Table:
        texts = unsqueezed(table["text"])
        words = _words(texts)
        hashes, inverse = np.unique(words.hashes, return_inverse=True)
        order, cuts = _by_bucket(hashes, buckets)
        count = np.zeros(len(hashes))
        for b, c in zip(back["bucket"].to_pylist(), back["counts"].to_pylist(), strict=True):
            count[order[cuts[b] : cuts[b + 1]]] = np.frombuffer(c, "<u8")
        of = words.text_of()
        sums = np.bincount(of, weights=np.log10(count + 1)[inverse], minlength=len(texts)) + np.log10(ends + 1)
        known = np.bincount(of, weights=(count > 0)[inverse], minlength=len(texts)).astype(np.int64) + (ends > 0)
        tokens = words.counts + 1
        columns = [table["id"], table["held_out"], pa.array(tokens), pa.array(known), pa.array(np.full(len(texts), n), pa.int64()), pa.array(sums - tokens * np.log10(n + v + 1)), pa.array(also(texts), pa.float64())]
        return pa.table(columns + [texts] * with_text, names=schema.names)

    return dealt.groupBy("grp").cogroup(answers.where("grp >= 0").groupBy("grp")).applyInArrow(look_up, schema)
