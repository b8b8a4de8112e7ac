"""All queries of the core and the SQL that checks them."""

from __future__ import annotations

from tamizal.plans import article_queries, audit_queries, eval_queries, pipeline_queries, retrieval_queries, table_queries, text_queries

_MODULES = (article_queries, audit_queries, eval_queries, pipeline_queries, retrieval_queries, table_queries, text_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: query for m in _MODULES for name, query in m.ORACLES.items()}
