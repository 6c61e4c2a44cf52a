"""Operators of a training-data pipeline: token counts, deduplication, filtering, scoring and file formats."""
