"""All core queries by name."""

from __future__ import annotations

from . import catalog_queries, frame_queries, problem_queries, quad_queries, report_queries, solve_queries, source_queries

MODULES = [catalog_queries, frame_queries, quad_queries, report_queries, solve_queries, source_queries, problem_queries]


def queries():
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
