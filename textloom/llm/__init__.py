"""Training-data operators: scoring, deduplication, mixing, tokenisation and packing.

Nothing outside this folder imports it.  Each module holds one operator; ``queries.py`` holds the thin registered queries and their SQL.
"""
