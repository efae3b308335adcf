"""Operators for large training-data pipelines (search, near-duplicates, quality, tokens, packing)."""
