"""Registered queries of the repository-intelligence engine and their DuckDB oracles."""

from __future__ import annotations

from . import graphs, history, hooks, lookups, retrieval, sessions, texts, tools

_MODULES = (retrieval, texts, history, graphs, lookups, sessions, tools, hooks)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
