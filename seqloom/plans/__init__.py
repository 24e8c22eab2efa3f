from seqloom.plans import graph_queries, pairwise_queries, stat_queries, stream_queries  # noqa: F401
from seqloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
