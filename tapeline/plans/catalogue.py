"""Loads every plan module and exposes the registry."""

from __future__ import annotations

import importlib
import pkgutil

from .. import plans
from .registry import REGISTRY, oracle, run

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _m not in ("registry", "catalogue"):
        importlib.import_module(f"{plans.__name__}.{_m}")


def names() -> list[str]:
    return list(REGISTRY)


__all__ = ["names", "oracle", "run"]
