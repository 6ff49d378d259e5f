"""Registered queries and the SQL that each is compared with."""

from sondera.plans import backtest_queries, corpus_queries, evidence_queries, more_queries, ranking_queries, source_queries  # noqa: F401
from sondera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
