"""All registered queries over series."""

from tidemark.plans import ahead_queries, diagnostic_queries, experiment_queries, model_queries, more_queries, significance_queries, sources_queries, frame_queries, whole_queries  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
