"""Every registered query and its oracle, by name."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in ("pit_queries", "function_queries", "aggregate_queries", "selection_queries", "player_queries", "source_queries", "model_queries", "inplay_queries", "extract_queries", "history_queries"):
    _module = importlib.import_module(f"{__name__}.{_name}")
    QUERIES |= _module.query.queries
    ORACLES |= _module.query.oracles
