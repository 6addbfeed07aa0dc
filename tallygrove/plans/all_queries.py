"""Every query of the business-analytics operators and its SQL."""

from __future__ import annotations

from tallygrove.plans import (  # noqa: F401
    aggregate_queries,
    context_queries,
    ingest_queries,
    kpi_queries,
    landed_queries,
    scan_queries,
    scenario_queries,
    scoring_queries,
    series_queries,
    window_queries,
)
from tallygrove.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
