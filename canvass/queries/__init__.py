"""Registered queries over the driver tables, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from canvass.queries.registry import ORACLES, QUERIES

MODULES: tuple[str, ...] = (
    "profiles", "evaluation", "paths", "planning", "answers", "documents", "tables", "augmenting",
)

for _name in MODULES:
    import_module(f"canvass.queries.{_name}")

__all__ = ["ORACLES", "QUERIES"]
