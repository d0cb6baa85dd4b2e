"""Operators for preparing training data: filtering, scoring, deduplication, packing."""
