"""Registered queries: each operator applied to the given tables, with its SQL counterpart."""

from __future__ import annotations

from importlib import import_module

from jobcast.checks.registry import ORACLES, QUERIES

SECTIONS = ("sources", "scalars", "filters", "windows", "aggregates", "ordering", "sampling",
            "clustering", "training", "plans", "streams")
for _section in SECTIONS:
    import_module(f"jobcast.checks.{_section}")

__all__ = ["QUERIES", "ORACLES"]
