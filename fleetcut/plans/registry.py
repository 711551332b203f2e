"""Every registered query by name, and the SQL it is compared with."""

from __future__ import annotations

import importlib

from fleetcut.plans.register import ORACLES, QUERIES, Query

_MODULES = ("timeline_queries", "speech_queries", "text_queries", "report_queries", "gate_queries", "source_queries")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"fleetcut.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
