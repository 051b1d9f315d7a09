from parlance.plans.analyses import QUERIES
from parlance.plans.oracle import oracle_queries

__all__ = ["QUERIES", "oracle_queries"]
