"""Composite queries: page search, index lookup, and the registered queries with their SQL."""

from . import box_queries, raster_queries, store_queries, stream_queries, text_queries  # noqa: F401
from .raster_queries import flagship
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
