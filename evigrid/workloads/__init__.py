"""Queries over the given tables."""

from importlib import import_module

FAMILIES = ("collection", "admission", "retrieval", "overlap", "html", "lifecycle", "repair", "bundle")


def load_all():
    from .registry import ORACLES, QUERIES
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
    return QUERIES, ORACLES
