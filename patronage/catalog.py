"""All queries of the library over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ("axes", "sales", "segments", "events", "scoring", "tickets", "models", "diagnostics")


def _load():
    from patronage.queries import registry

    for name in MODULES:
        importlib.import_module(f"patronage.queries.{name}")
    return registry


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict:
    return dict(_load().ORACLE_SQL)
