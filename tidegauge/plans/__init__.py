"""All queries outside the corpus subpackage."""

from tidegauge.plans import audit_queries, candidate_queries, function_queries, solver_queries, store_queries, stream_queries, task_queries, verification_queries, tool_queries  # noqa: F401
from tidegauge.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
