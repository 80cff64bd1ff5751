"""Operators for preparing training data: sharding, deduplication, filtering, packing and token files.

Nothing outside this subpackage imports it.
"""
