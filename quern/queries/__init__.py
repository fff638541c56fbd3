"""Queries for the core operators and their SQL, by topic."""

from quern.queries import counts, graphs, samples, segmentation, sequences, similarity, symbols, vocabularies  # noqa: F401
from quern.queries.registry import Query, oracle_sql, queries

__all__ = ["Query", "oracle_sql", "queries"]
