"""Operators for preparing training data: archives, search, deduplication, quality, tokens, mixing.

Nothing outside this subpackage imports it; ``queries`` holds the thin
``opN_`` queries and their SQL.
"""
