"""Corpus operators: search, packing, scoring, deduplication and decontamination."""
