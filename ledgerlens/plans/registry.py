"""Every registered query with its SQL twin, gathered from the query modules."""

from ledgerlens.plans import (  # noqa: F401
    queries_graph, queries_ledger, queries_report, queries_store, queries_stream, queries_text,
)
from ledgerlens.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
