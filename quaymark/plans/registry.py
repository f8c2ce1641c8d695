"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from quaymark.plans import bar_queries, board_queries, chance_queries, event_queries, ledger_queries, model_queries, selection_queries, signal_queries, source_queries, state_queries, table_queries, trend_queries, volatility_queries  # noqa: F401
from quaymark.plans.shape import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
