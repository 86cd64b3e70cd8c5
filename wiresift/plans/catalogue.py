"""All registered queries."""

from wiresift.plans import (  # noqa: F401
    flow_queries, header_queries, inspect_queries, report_queries, run_queries, streaming_queries)
from wiresift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
