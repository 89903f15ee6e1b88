"""All queries of the core library by name."""

from __future__ import annotations

import importlib

_MODULES = ["problems", "listing", "ranking", "lifecycle", "safety", "recall", "upkeep"]


def _modules():
    return [importlib.import_module(f"{__package__}.{m}") for m in _MODULES]


def flagship(spark, sf_dir):
    return queries()["r10_hybrid"](spark, sf_dir)


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out |= m.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.oracle_sql()
    return out
