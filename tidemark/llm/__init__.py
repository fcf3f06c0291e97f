"""Operators of a large-scale training-data pipeline.

Nothing outside this folder imports it; ``queries.py`` holds the registered
queries and their SQL.
"""
