"""All queries of the analytics side by name, and the SQL that gives the same rows."""

from __future__ import annotations

from quillon.plans import data_queries, metric_queries, stored_queries

QUERIES = metric_queries.QUERIES | data_queries.QUERIES | stored_queries.QUERIES
ORACLES = metric_queries.ORACLES | data_queries.ORACLES | stored_queries.ORACLES
