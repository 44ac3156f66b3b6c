"""Queries over the given tables, one per operator, with the SQL they are checked against."""

from .registry import ORACLES, QUERIES
from . import captures, dash, hls, records, resolving, sources, streams, traffic, transfers  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
