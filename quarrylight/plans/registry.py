"""Collects the queries of the library and their SQL twins."""

from __future__ import annotations

from quarrylight.plans import helper_queries, index_queries, lookup_queries, text_queries

_MODULES = (lookup_queries, index_queries, text_queries, helper_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
