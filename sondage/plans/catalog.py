"""All named queries; importing a module registers its queries."""

from __future__ import annotations

import importlib

from sondage.plans.registry import CHECKS, QUERIES

MODULES = [
    "shift_queries",
    "item_queries",
    "population_queries",
    "skiplogic_queries",
    "probe_queries",
    "log_queries",
    "defect_queries",
    "report_queries",
    "stream_queries",
    "sink_queries",
]
for _name in MODULES:
    importlib.import_module(f"sondage.plans.{_name}")

__all__ = ["CHECKS", "QUERIES"]
