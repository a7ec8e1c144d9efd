"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES = ["link_queries", "source_queries", "group_queries", "audit_queries", "stream_queries"]


def load() -> ModuleType:
    """Import every module that registers queries and return the registry."""
    for name in MODULES:
        importlib.import_module(f"hrefmill.catalog.{name}")
    return importlib.import_module("hrefmill.catalog.registry")
