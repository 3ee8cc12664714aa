"""Training-data pipeline operators: quality, WARC, tokens, PII, dedup, sharding.

Nothing outside this subpackage imports it; its queries are registered by
``strandlake.llm.registry``.
"""
