"""Queries on the given tables, one module per operator family."""

import importlib
import pkgutil

from . import registry


def load_all():
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.ORACLES
