"""Scalar functions: text cleaning, token counts, splitting, references, versions."""
