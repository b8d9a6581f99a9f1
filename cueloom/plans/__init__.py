"""Queries over the given tables."""

from . import cue_queries, job_queries, matching_queries, reuse_queries, scalar_queries, signal_queries  # noqa: F401
from . import enrich_queries, live_queries  # noqa: F401
from .registry import QUERIES

__all__ = ["QUERIES"]
