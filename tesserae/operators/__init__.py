"""Relational, graph, search and context operators on DataFrames."""
