"""Importing this module registers every query."""

from bindscape.plans import (  # noqa: F401
    interval_queries,
    metric_queries,
    model_queries,
    normalize_queries,
    peak_queries,
    rank_queries,
    sample_queries,
    sequence_queries,
    signal_queries,
    source_queries,
)
from bindscape.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
