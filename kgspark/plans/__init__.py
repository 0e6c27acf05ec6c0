"""Registered queries, one module per area."""

from __future__ import annotations

import importlib

MODULES = ("summaries", "views", "connections", "networks", "texts", "research", "building", "validating", "streams", "exporting", "portable")


def all_modules() -> None:
    for name in MODULES:
        importlib.import_module(f"kgspark.plans.{name}")
