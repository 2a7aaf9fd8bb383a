"""Queries over the logical tables: single operators and whole pipelines."""
