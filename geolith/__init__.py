"""Toponym resolution and geoparsing on Spark DataFrames."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"
_PLACES = {"Geoparser": "geolith.plans.geoparse", "build_gazetteer": "geolith.operators.gazetteer", "evaluate": "geolith.operators.evaluate"}
__all__ = [*_PLACES]


def __getattr__(name: str):
    """Public names are imported when asked for, as workers import this package too."""
    if name in _PLACES:
        return getattr(importlib.import_module(_PLACES[name]), name)
    raise AttributeError(name)
