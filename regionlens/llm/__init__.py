"""Operators for building training data: language, toxicity, duplicates, contamination, tokens, packing, sharding, pages.

Nothing outside this folder imports it.
"""
