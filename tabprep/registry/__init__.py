"""All queries by name, gathered from the modules of this folder."""

from __future__ import annotations

from importlib import import_module

MODULES = ("prep", "features", "sources", "catalog", "scores", "profile", "balance", "models")


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"{__name__}.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query defined twice: {clash}")
        out.update(part)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
