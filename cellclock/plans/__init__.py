"""Compositions of operators: fixture views, dataset assembly and the queries."""

from importlib import import_module

MODULES = ("scalars", "lookups", "profiles", "reshaping", "rasters", "scores", "models", "files", "assembly", "streams")


def load_all() -> None:
    from importlib.util import find_spec

    for name in MODULES:
        full = f"cellclock.plans.{name}_queries"
        if find_spec(full):
            import_module(full)
