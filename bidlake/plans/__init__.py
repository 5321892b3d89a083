"""Registered queries over the driver tables."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES, functions of (spark, sf_dir), and SQL, by their names.
MODULES = ("pricing", "catalog", "documents", "evaluation", "desk", "decisions", "intake", "streams")


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in import_module(f"bidlake.plans.{m}").QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"bidlake.plans.{m}").SQL.items()}
