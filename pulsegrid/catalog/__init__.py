"""Registered queries, each with the SQL that states its result where SQL can."""

from __future__ import annotations

from pulsegrid.catalog import cluster, evaluate, extract, features, forecast, prepare, sources, storage, windows

_MODULES = [sources, storage, extract, windows, features, evaluate, prepare, cluster, forecast]


def all_queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def all_oracles() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
