"""All registered queries and oracles, gathered from the plan modules."""

from __future__ import annotations

import importlib

_MODULES = ["retrieval", "profiles", "recommendation", "flagship", "evaluation", "ingestion", "catalogue", "streams"]


def _load():
    queries, oracles = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"prefspark.plans.{m}")
        queries.update(mod.QUERIES)
        oracles.update(getattr(mod, "ORACLES", {}))
    return queries, oracles


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
