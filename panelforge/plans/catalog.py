"""All registered queries."""

from __future__ import annotations

import importlib

from panelforge.plans.registry import QUERIES

for _part in ("sources", "index", "learning", "evaluation", "trades", "portfolio"):
    importlib.import_module(f"panelforge.plans.catalog_{_part}")

__all__ = ["QUERIES"]
