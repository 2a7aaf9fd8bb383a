"""All queries over the logical tables: importing this module fills the registry."""

from tesserae.plans import aggregate_queries, document_queries, graph_queries, pipeline_queries, record_queries, row_queries, search_queries, stream_queries, text_queries  # noqa: F401
from tesserae.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
