"""All registered queries and their check SQL."""

from __future__ import annotations

from importlib import import_module

_PARTS = ("catalog_rows", "catalog_graph", "catalog_series", "catalog_grid", "catalog_stream",
          "catalog_archive")


def _collect(name: str) -> dict:
    out: dict = {}
    for part in _PARTS:
        out.update(getattr(import_module(f"skylattice.plans.{part}"), name))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
