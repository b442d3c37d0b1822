"""Registered queries, grouped by area."""

from __future__ import annotations

import importlib

from trialspark.plans.registry import ORACLES, QUERIES

AREAS: list[str] = [
    "trials",
    "windows",
    "text",
    "statistics",
    "doe",
    "catalog",
    "corpus",
    "render",
    "sources",
    "streams",
    "extension",
]


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"trialspark.plans.{area}")


__all__ = ["ORACLES", "QUERIES", "load"]
