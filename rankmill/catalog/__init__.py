"""Runnable queries over the shared tables, one per operator, with their SQL twins."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL

_MODULES = ("distributions", "rollups", "panels", "joins", "curves", "modelling", "texts")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
