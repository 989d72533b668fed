"""The registry of named queries and their SQL."""

from __future__ import annotations

import importlib
import pkgutil
from types import ModuleType


def modules() -> list[ModuleType]:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__)]


def registry(found: list[ModuleType]) -> tuple[dict, dict]:
    """Every query of the modules and, where there is one, its SQL."""
    queries, sql = {}, {}
    for m in found:
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
