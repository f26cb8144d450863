"""Training-data operators: scoring, deduplication, mixing, sharding, archives and tokens.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
