"""Operators for large-scale training data: filters, deduplication, scans, counts and packing."""
