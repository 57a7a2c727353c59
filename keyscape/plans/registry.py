"""All registered queries (name -> callable(spark, sf_dir)) and their DuckDB oracles."""

from __future__ import annotations

from . import audit_plans, compare_plans, evidence_plans, keyspace_plans, normalize_plans, source_plans

_PLANS = (compare_plans, audit_plans, evidence_plans, keyspace_plans, normalize_plans, source_plans)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
