"""All queries of the library outside the training-data package."""

import importlib
import pkgutil

from quarrystone import queries
from quarrystone.queries.registry import ORACLES, QUERIES

for _module in pkgutil.iter_modules(queries.__path__):
    importlib.import_module(f"quarrystone.queries.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
