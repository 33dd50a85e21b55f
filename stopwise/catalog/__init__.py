"""Query catalogue: one module per area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("temporal", "summary", "feeds", "scalars", "model", "flow", "whole")


def catalogs():
    """The catalogues of all areas, in order."""
    return [import_module(f"stopwise.catalog.{area}").CATALOG for area in AREAS]
