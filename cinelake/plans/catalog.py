"""All registered queries, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from . import listing, matching, names, providers, signals

_GROUPS = (matching, listing, names, providers, signals)
QUERIES = {name: f for g in _GROUPS for name, f in g.QUERIES.items()}
ORACLE_SQL = {name: sql for g in _GROUPS for name, sql in g.ORACLE_SQL.items()}
FLAGSHIP = "tfidf_cosine_topk"
