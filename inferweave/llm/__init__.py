"""Training-data operators: tokenization, archives, scoring, extraction, deduplication, mixing, sharding.

Nothing outside this subpackage imports it.
"""
