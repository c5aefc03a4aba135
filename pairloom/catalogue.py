"""Every named query with its DuckDB statement."""

from pairloom.plans import indicator_queries, pair_queries, report_queries  # noqa: F401
from pairloom.registry import ORACLES, QUERIES  # noqa: F401
