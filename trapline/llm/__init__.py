"""Operators for preparing training data (sharding, dedup, filters, search)."""
