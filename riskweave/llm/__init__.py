"""Training-data operators: filtering, deduplication, mixing, formatting and packing.

Nothing outside this subpackage imports it; its queries are in ``riskweave.llm.queries``.
"""
