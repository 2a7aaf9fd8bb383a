"""Operator 8: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.wordbpe import MergeCounter, reader


def load_vocabulary(path: str) -> bytes:
    """The vocabulary's file, read once on the driver; its size is that of a tokenizer, not of the data."""
    with open(path, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, vocabulary: bytes, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, in one pass without a shuffle.

    A piece's symbols form a linked list; a heap gives the adjacent pair of the
    lowest rank (leftmost first) until none can merge. The count is the initial
    symbols less the merges. Null texts count as empty: 0 bytes, 0 tokens.
    Repeated rows each give a row; an empty table gives none; null ids stay.
    Texts are read whole, whatever their length.
    """
    key = hashlib.sha256(vocabulary).hexdigest()
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        of = reader(MergeCounter, key, spec.value)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([of.read(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), n], names=schema.names)

    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
