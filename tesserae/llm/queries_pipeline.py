"""Query of the whole corpus pipeline."""

from corpus_pipeline import ORACLE_SQL, run
from tesserae.llm.registry import query

query("pipeline", ORACLE_SQL)(run)
