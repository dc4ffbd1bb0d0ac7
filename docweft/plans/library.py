"""All queries for the engine's own operators."""

from . import compose_queries, join_queries, kernel_queries, placement_queries, report_queries, rule_queries, scalar_queries, stream_queries, text_queries, tree_queries, window_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
