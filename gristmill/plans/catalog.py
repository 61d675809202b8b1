"""All core queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from gristmill.plans import corpus, fields, reports, retrieval, scores

_MODULES = (corpus, fields, retrieval, scores, reports)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
FLAGSHIP = "bm25_topk"
