"""Request router and the registered queries."""

from __future__ import annotations

from importlib import import_module

QUERY_MODULES = [
    "price_queries",
    "listing_queries",
    "attribute_queries",
    "search_queries",
    "valuation_queries",
    "stream_queries",
    "history_queries",
]


def load():
    """Import every query module once; gives (queries, oracles)."""
    for name in QUERY_MODULES:
        import_module(f"marketlens.plans.{name}")
    from marketlens.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
