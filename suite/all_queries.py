"""All registered queries."""

from suite import q_sources, q_filters, q_analyzers, q_joins, q_views, q_reshape  # noqa: F401, I001
from suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
