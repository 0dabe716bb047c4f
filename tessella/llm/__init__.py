"""Training-data operators: mixing, extraction, quality, PII, near copies,
sharding, exact search, packing and chat formatting.

Nothing outside this subpackage imports it.
"""
