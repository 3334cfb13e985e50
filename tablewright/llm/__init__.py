"""Operators for preparing training data: deduplication, filtering, search, scoring and packing of large text tables."""
