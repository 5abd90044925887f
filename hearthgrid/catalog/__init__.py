"""Registered queries, one module per chapter of the inventory."""

from __future__ import annotations

import importlib

from hearthgrid.catalog import registry

CHAPTERS = ("projections", "filters", "neighbours", "aggregates", "fields", "spreading", "io", "learning")


def load():
    """Import every chapter once and return the filled registry."""
    for chapter in CHAPTERS:
        importlib.import_module(f"{__name__}.{chapter}")
    return registry
