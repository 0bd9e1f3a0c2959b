"""Registered queries over the test tables, each with the SQL that gives the same result."""

from __future__ import annotations

import importlib

from tablewash.workloads.registry import ORACLES, QUERIES, Query

_MODULES = ("steps_queries", "profile_queries", "score_queries", "recipe_queries", "edge_queries")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"tablewash.workloads.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
