"""Registered queries: operators applied to the given tables."""

from cohortlake.plans import (  # noqa: F401
    chat_queries,
    portfolio_queries,
    report_queries,
    results_queries,
    scoring_queries,
    streaming_queries,
    table_queries,
    user_queries,
)
from cohortlake.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
