"""Queries of the sequence operators, by name, with their SQL."""

from __future__ import annotations

from strandlake.plans import graph_queries, hitting_queries, io_queries, kmer_queries, ordered_queries, store_queries  # noqa: F401
from strandlake.plans.common import ORACLE_SQL, QUERIES
from strandlake.plans.kmer_queries import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
