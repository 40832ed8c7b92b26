"""Queries over the driver tables, grouped by area; importing this package registers all of them."""

from importlib import import_module
from pkgutil import iter_modules

from clausework.plans.registry import REGISTRY

for _module in sorted(m.name for m in iter_modules(__path__)):
    import_module(f"{__name__}.{_module}")

__all__ = ["REGISTRY"]
