"""All queries of the array engine, with the equivalent SQL where SQL can say it."""

from __future__ import annotations

from . import patch_queries, space_queries, table_queries

QUERIES = space_queries.QUERIES | patch_queries.QUERIES | table_queries.QUERIES
ORACLE_SQL = space_queries.SQL | patch_queries.SQL | table_queries.SQL
