"""Registered queries and their SQL."""

from __future__ import annotations

from . import audit_queries, document_queries, made_queries, page_queries, rule_queries, store_queries

_MODULES = (audit_queries, page_queries, rule_queries, document_queries, made_queries, store_queries)

QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
