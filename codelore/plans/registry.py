"""Collects ``QUERIES`` and ``ORACLES`` of the query modules."""

from __future__ import annotations

from importlib import import_module

MODULES: list[str] = [
    "codelore.plans.stored",
    "codelore.plans.textual",
    "codelore.plans.code",
    "codelore.plans.agent",
    "codelore.plans.graphs",
    "codelore.plans.subjects",
    "codelore.plans.built",
    "codelore.plans.searches",
    "codelore.plans.answers",
]


def collect(modules: list[str]) -> tuple[dict, dict]:
    """Queries and oracle SQL of ``modules``; a name that is registered twice is an error."""
    queries: dict = {}
    oracles: dict = {}
    for name in modules:
        module = import_module(name)
        if twice := queries.keys() & module.QUERIES.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    if stray := oracles.keys() - queries.keys():
        raise ValueError(f"SQL without a query: {sorted(stray)}")
    return queries, oracles
