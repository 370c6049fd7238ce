"""End-to-end queries over the driver's tables."""

import importlib
import pkgutil


def load_queries():
    """All registered queries and their checking SQL, by name."""
    from pathloom.plans import registry

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.CHECKS
