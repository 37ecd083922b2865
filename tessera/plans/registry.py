"""All queries of the core, by name, with the SQL that gives the same result."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("problems", "scalars", "graphs", "retrieval", "storage", "texts", "streams")


def _all(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        part = getattr(import_module(f"tessera.plans.{m}"), what)
        assert not out.keys() & part.keys(), f"a name is used twice: {out.keys() & part.keys()}"
        out |= part
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")
