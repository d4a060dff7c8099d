"""Registered queries and the SQL that checks them.

Each module holds ``QUERIES`` (name -> function of session and data folder) and
``ORACLES`` (name -> SQL over the same tables).
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "segments",
    "vocabulary",
    "resolution",
    "boundaries",
    "validation",
    "sampling",
    "scoring",
    "analytics",
    "long",
)


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        found.update(getattr(module, attribute))
    return found


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict[str, str]:
    return _collect("ORACLES")
