"""Queries over the driver tables, each next to its SQL."""

import importlib

from emberframe.catalog.registry import ORACLES, QUERIES

for _module in ("grip", "timing", "alignment", "pixels", "studies", "classifiers", "pairs", "sessions", "scalars", "shapes", "streams", "timed", "plans", "files"):
    importlib.import_module(f"emberframe.catalog.{_module}")

__all__ = ["ORACLES", "QUERIES"]
