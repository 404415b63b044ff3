"""All queries of the library with their SQL oracles."""

from __future__ import annotations

from loomery.plans import log_queries, lookup_queries, markup_queries, page_queries, result_queries, surveyed_queries  # noqa: F401  they register their queries
from loomery.plans.queries import ORACLES, QUERIES

FLAGSHIP = "host_summary"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
