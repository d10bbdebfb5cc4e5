"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from orbitloom.plans import assembly_queries, check_queries, fleet_queries, fold_queries, forecast_queries, function_queries, navigation_queries, orbit_queries, queries, store_queries, verdict_queries

_MODULES = (queries, fleet_queries, function_queries, store_queries, check_queries, orbit_queries, fold_queries, assembly_queries, verdict_queries, forecast_queries, navigation_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict = {name: text for m in _MODULES for name, text in m.SQL.items()}
FLAGSHIP = "w2_current_conditions"
