"""The catalogue of registered queries and the SQL that each must agree with."""

from __future__ import annotations

from lorekeep.plans import log_queries, store_queries, workflow_queries

assert workflow_queries and store_queries  # they register their queries with the others
QUERIES = dict(log_queries.QUERIES)
ORACLE_SQL = dict(log_queries.SQL)
FLAGSHIP = log_queries.fold_balance
