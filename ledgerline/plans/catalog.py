"""All registered queries."""

from ledgerline.plans import domain_queries, format_queries, live_queries, log_queries, more_queries, state_queries  # noqa: F401
from ledgerline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
