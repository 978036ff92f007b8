"""Registered queries with the SQL each one is checked against."""

from __future__ import annotations

import importlib

MODULES = ["text", "payload", "reports", "scoring", "states", "figures", "streams", "files"]


def collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"proofspark.catalog.{name}"), attribute))
    return out
