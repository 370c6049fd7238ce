"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import importlib
import pkgutil


def load_queries():
    """The package's queries and their checking SQL, by name."""
    from pathloom.llm import registry

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.CHECKS
