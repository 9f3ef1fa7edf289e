"""All queries of the core library, with their SQL."""

from __future__ import annotations

from citeloom.plans import entry_queries, marker_queries, orphan_queries, paper_queries, structure_queries

FLAGSHIP = "citation_report"
_MODULES = (marker_queries, structure_queries, entry_queries, paper_queries, orphan_queries)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
