"""Operators of a training-data pipeline: deduplication, quality, language, privacy, packing."""
