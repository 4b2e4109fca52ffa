"""All registered queries with their SQL."""

from __future__ import annotations

import importlib

MODULES = ("grid_queries", "model_queries", "stream_queries", "more_queries", "correction_queries")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

for _m in MODULES:
    _q = importlib.import_module(f"latticework.plans.{_m}").q
    QUERIES |= _q.queries
    ORACLE_SQL |= _q.sql
