"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from importlib import import_module

MODULES = ("profiling", "quality", "vaulting", "graphs", "texts", "loads")


def load_all() -> tuple[dict, dict]:
    """(queries, reference SQL) by key."""
    for name in MODULES:
        import_module(f"sievework.registered.{name}")
    registry = import_module("sievework.registered.registry")
    return registry.QUERIES, registry.ORACLES
