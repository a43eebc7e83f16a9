"""All queries of the core, by name, with the SQL they are compared with."""

from __future__ import annotations

from packlake.plans import graph_queries, rank_queries, scan_queries, snapshots, stream_queries

_MODULES = (snapshots, scan_queries, rank_queries, graph_queries, stream_queries)
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: text for module in _MODULES for name, text in module.ORACLES.items()}
flagship = QUERIES["budget_select"]
