"""Registered queries over the shared Parquet tables, each beside its SQL oracle."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("ranking", "text", "lifecycle", "tracking", "sources", "metrics")


def load():
    """Import every binding module once and return ``(queries, oracles)``."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES
    return QUERIES, ORACLES
