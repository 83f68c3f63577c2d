"""Registered queries over the driver tables, each with an independent SQL statement."""

from __future__ import annotations

import importlib

from gateflow.queries.registry import QUERIES, SQL

for _name in ("flow", "calendar", "history", "statistics", "profiling", "network", "riders", "forecasts", "models", "files"):
    importlib.import_module(f"gateflow.queries.{_name}")

__all__ = ["QUERIES", "SQL"]
