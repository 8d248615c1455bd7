"""Registered queries: each name maps to a Spark plan and, where SQL can say it, to SQL text."""

from __future__ import annotations

import importlib

from tidewell.plans.registry import QUERIES, SQL

_MODULES = ("timelines", "series", "profiles", "dataset", "gates", "text", "vectors", "evaluation", "graphs", "mutations", "streams", "files")


def load_all() -> None:
    for name in _MODULES:
        try:
            importlib.import_module(f"tidewell.plans.{name}")
        except ModuleNotFoundError as missing:
            if missing.name != f"tidewell.plans.{name}":
                raise


__all__ = ["QUERIES", "SQL", "load_all"]
