"""Named queries over the driver tables, grouped by suite."""

from __future__ import annotations

import importlib

SUITES = ("functions_suite", "sources_suite", "relational_suite", "bots_suite", "ato_suite", "chargeback_suite", "warehouse_suite", "series_suite", "graph_suite", "ml_suite", "streaming_suite", "sql_suite", "playbook_suite", "roles_suite")


def all_suites() -> None:
    for name in SUITES:
        importlib.import_module(f"inquest.plans.{name}")
