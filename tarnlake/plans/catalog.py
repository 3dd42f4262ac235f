"""All queries of the library itself, by name."""

from __future__ import annotations

from importlib import import_module

from tarnlake import registry

FLAGSHIP = "first_seen_over_time"
MODULES = ("tarnlake.plans.timeline", "tarnlake.plans.relational", "tarnlake.plans.scalar", "tarnlake.plans.table_queries", "tarnlake.plans.domain", "tarnlake.plans.storage", "tarnlake.plans.operator_queries")


def _load() -> None:
    for name in MODULES:
        import_module(name)


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
