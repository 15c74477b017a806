"""Training-data operators: scoring, filtering, deduplication, mixing, encoding.

Nothing outside this subpackage imports it.
"""
