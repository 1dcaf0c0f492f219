"""Queries over the lifted tables, one module per family."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
