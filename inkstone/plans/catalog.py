"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from inkstone.plans import layout_queries, ledger_queries, record_queries, structure_queries, text_queries

MODULES = [ledger_queries, text_queries, layout_queries, structure_queries, record_queries]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
