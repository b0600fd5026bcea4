"""Operators for preparing training text: sharding, packing, counting, filtering, deduplication."""
