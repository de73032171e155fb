"""The queries over the driver's tables and their SQL."""

from __future__ import annotations

from . import compare_queries, contact_queries, graph_queries, run_queries, sequence_queries, source_queries, tour_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (contact_queries, sequence_queries, source_queries, graph_queries, tour_queries, compare_queries, run_queries):
    QUERIES |= _module.BOOK.queries
    ORACLES |= _module.BOOK.oracles
