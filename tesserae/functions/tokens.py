"""Token counts by a model's own byte-pair vocabulary, next to the rule of thumb of ``functions.text``.

The vocabulary's file (a line for each token: its bytes in base 64, its rank) and the
pattern that cuts texts into pieces are the caller's. Spark reads the file, so it may
lie in any store that Spark reads; its size is checked before it is broadcast.
"""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Bytes of a vocabulary's file, at most; those in use have a few million.
LARGEST = 64 << 20

_ENCODERS: dict[str, object] = {}


class ModelTokens:
    """Counts a text's tokens; strings of special tokens in a text are ordinary text. A worker makes the encoder once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        found = spark.read.format("binaryFile").load(path)
        size = found.agg(F.sum("length")).first()[0] or 0
        if not 0 < size <= LARGEST:
            raise ValueError(f"a vocabulary of {size} bytes; it has to have between 1 and {LARGEST}")
        data = found.select("content").first()[0]
        self.name = hashlib.sha256(data + pattern.encode()).hexdigest()
        self.pattern, self.data = pattern, spark.sparkContext.broadcast(bytes(data))

    def _encoder(self):
        if self.name not in _ENCODERS:
            import tiktoken

            lines = (line.split() for line in self.data.value.splitlines())
            ranks = {base64.b64decode(x[0]): int(x[1]) for x in lines if x}
            _ENCODERS[self.name] = tiktoken.Encoding(self.name, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _ENCODERS[self.name]

    def count(self, text: str | None) -> int:
        """The text's tokens; a null text has none."""
        return len(self._encoder().encode_ordinary(text)) if text else 0

    def column(self, text):
        """The tokens of a text column."""

        @F.pandas_udf("long")
        def counted(texts: pd.Series) -> pd.Series:
            return texts.map(self.count).astype("int64")

        return counted(text)
