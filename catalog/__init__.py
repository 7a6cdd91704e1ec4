"""Every registered query, and the SQL that checks it."""

from importlib import import_module

GROUPS = ["intake", "profiling", "statistics", "shapes", "narration", "layouts"]


def _collect(kind: str) -> dict:
    found = {}
    for group in GROUPS:
        found |= getattr(import_module(f"catalog.{group}"), kind)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")
