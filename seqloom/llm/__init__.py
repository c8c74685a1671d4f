"""Operators of a training-data pipeline (sharding, dedup, filtering, mixing, formatting, search).

Nothing outside this subpackage imports it; ``registry`` lists its queries and SQL twins.
"""
