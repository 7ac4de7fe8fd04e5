"""Operators for preparing training text at scale.

Nothing else in the library imports this package. Each module holds one operator with
its own interface; `queries.py` registers the thin queries over the given tables.
"""
