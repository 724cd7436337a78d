"""Operators for training-data pipelines: extraction, sharding, filtering, deduplication, packing.

Nothing else in the library imports this subpackage.
"""
