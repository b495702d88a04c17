"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin queries that the entry module registers.
"""
