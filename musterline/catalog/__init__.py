"""Registered queries and the SQL each is checked against."""

from musterline.catalog import attendance, exits, trends  # noqa: F401  (registration)
from musterline.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
