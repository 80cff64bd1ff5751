"""Registered queries and their SQL."""

from __future__ import annotations

from functools import lru_cache

from shockwell.plans import daily, fits, hourly, ingest, panels, shocks
from shockwell.plans.registry import Query, Registry


@lru_cache(maxsize=1)
def registry() -> Registry:
    r = Registry()
    for part in (daily, shocks, hourly, fits, panels, ingest):
        part.register(r)
    return r


def queries() -> dict[str, Query]:
    return dict(registry().queries)


def oracle_sql() -> dict[str, str]:
    return dict(registry().sql)
