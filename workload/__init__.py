"""Registered queries and their SQL twins over the given tables."""

from importlib import import_module

MODULES = ("frames", "tensors", "state", "catalogs", "streams")


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
