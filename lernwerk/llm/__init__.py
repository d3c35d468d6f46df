"""Corpus preparation operators: deduplication, filtering, sharding, mixing, tokenising.

Nothing outside this folder imports it; the entry module adds its queries only
when it can be imported.
"""
