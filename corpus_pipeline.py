"""A corpus pipeline: language, near duplicates, repeated spans, contamination, packing.

Each stage works on all that the one before it kept. All but the last return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import is_held_out, table, written
from tesserae.llm.decontaminate import decontaminate
from tesserae.llm.language import fit_languages, with_known_language
from tesserae.llm.near_duplicates import without_near_duplicates
from tesserae.llm.packing import pack
from tesserae.llm.queries_tokens import vocabulary_path
from tesserae.llm.substrings import without_repeats
from tesserae.llm.token_counts import load_vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null texts among them) and texts far from every known language; without any
    labelled text no distance is known and all texts with a letter stay. Repeated rows stay, an empty table stays empty."""
    return with_known_language(docs, fit_languages(docs.where(~is_held_out(F.col("doc_id"), 5, 0))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the least id; rows without an id, and texts without words, stay."""
    return without_near_duplicates(docs, shingle=5, num=80, den=100)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes spans of 35 words or more that occur twice out of the texts; null and short texts stay as they are."""
    return without_repeats(docs, window=35)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark text; null texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents", n=13, share=20)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenises the documents and packs them into sequences of 4096 tokens; a null text is one end, a repeated row is packed again."""
    return pack(docs, load_vocabulary(vocabulary_path()), max_tokens=4096)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", contamination),
    ("best_fit_packing", packing),
]

#: Tokenising and learned centroids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
