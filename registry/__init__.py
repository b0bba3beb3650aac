"""Registered queries: operators applied to the given tables, with equivalent SQL where whole tables are feasible."""

from __future__ import annotations

import importlib

MODULES = ("selection", "dedup", "delivery", "feed", "fetchlog", "scanlog", "columns", "media", "pages", "streams", "lifecycles")


def load():
    from registry import base

    for name in MODULES:
        importlib.import_module(f"registry.{name}")
    return base.QUERIES, base.ORACLES
