"""Named queries over the given tables, with the SQL each is checked against."""

from importlib import import_module

SECTIONS = ["tables", "aggregation", "functions", "charts", "areas", "features", "pricing", "serving", "jobs"]


def load():
    """Import every section once and return the registry."""
    for section in SECTIONS:
        import_module(f"parcelmill.catalog.{section}")
    return import_module("parcelmill.catalog.registry")
