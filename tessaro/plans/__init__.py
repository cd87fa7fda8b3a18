"""Registered queries over the test tables, with their oracles."""

from __future__ import annotations

import importlib

from tessaro.plans.registry import ORACLES, QUERIES, with_views

MODULES = ("ingest", "point_in_time", "portfolios", "performance", "evidence", "gates", "streams", "artifacts")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessaro.plans.{name}")


def all_queries() -> dict:
    load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    load()
    return {k: with_views(v) for k, v in ORACLES.items()}
