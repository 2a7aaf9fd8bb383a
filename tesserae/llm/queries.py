"""All queries of the corpus operators: importing this module fills the registry."""

from tesserae.llm import queries_classifiers, queries_conversations, queries_decontaminate, queries_dedup, queries_language, queries_lm, queries_mixing, queries_pipeline, queries_search, queries_tokens, queries_words  # noqa: F401
from tesserae.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
