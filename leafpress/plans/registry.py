"""All queries of the engine and the same in DuckDB SQL."""

from __future__ import annotations

from leafpress.plans import plugin_plans, reading_plans, runtime_plans, table_plans, text_plans

_PLANS = (text_plans, runtime_plans, table_plans, reading_plans, plugin_plans)
QUERIES = {k: f for m in _PLANS for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _PLANS for k, s in m.ORACLES.items()}
