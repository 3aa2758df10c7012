"""Registered queries of the network engine and of the jobs, and their SQL."""

from weftnet import job_queries, queries
from weftnet.queries import flagship

QUERIES = queries.QUERIES | job_queries.QUERIES
ORACLES = queries.ORACLES | job_queries.ORACLES

__all__ = ["ORACLES", "QUERIES", "flagship"]
