"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from cladeworks.plans import control_plans, extra_plans, graph_text_plans, taxonomy_plans, triplet_plans, vector_plans

MODULES = [taxonomy_plans, triplet_plans, vector_plans, graph_text_plans, control_plans, extra_plans]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
