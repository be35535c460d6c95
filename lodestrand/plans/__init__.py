"""Registered queries over the driver's tables, with DuckDB SQL for those that SQL can express."""

from lodestrand.plans import agent, evals, evaluation, frozen, ingestion, layout, retrieval, service, stores, streams, tables, texts
from lodestrand.plans.registry import ORACLES, QUERIES

__all__ = ["agent", "evals", "evaluation", "frozen", "ingestion", "layout", "oracle_sql", "queries", "retrieval", "service", "stores", "streams", "tables", "texts"]


def queries() -> dict:
    """Every registered query."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query."""
    return dict(ORACLES)
