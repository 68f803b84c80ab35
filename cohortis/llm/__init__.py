"""Corpus operators: sharding, deduplication, filtering, counting, mixing, packing and vector search.

Nothing else in the library imports this package.
"""
