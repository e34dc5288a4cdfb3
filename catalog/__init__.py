"""Registered queries: each operator bound to the given tables, with its SQL twin."""

from catalog import q_aggregates, q_cells, q_composites, q_filters, q_joins, q_mergeable, q_refresh, q_requests, q_scalars, q_sources  # noqa: F401
from catalog.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
