"""All queries over the driver tables."""

from __future__ import annotations

from strandweave.plans import contact_queries, graph_queries, sensing_queries, stat_queries, stream_queries, trace_queries  # noqa: F401  they register their queries
from strandweave.plans._registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
