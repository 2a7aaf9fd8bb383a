"""Queries of the tokeniser operators (2 and 8)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import table
from tesserae.llm.packing import pack
from tesserae.llm.registry import query
from tesserae.llm.token_counts import count_tokens, load_vocabulary


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_vocabulary(vocabulary_path()), limit=2048)


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), load_vocabulary(vocabulary_path()), max_tokens=4096)
