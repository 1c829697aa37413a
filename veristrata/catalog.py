"""Registry of this library's own queries and of their SQL statements."""

from __future__ import annotations

from veristrata.plans import chains, entries, more_queries, probes, storage  # noqa: F401  register their queries
from veristrata.plans.queries import ORACLES, QUERIES

FLAGSHIP = "contributor_ranking"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
