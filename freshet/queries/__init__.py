"""Registered queries: each runs on the sample tables and carries its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists inventory ids."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(fn, tuple(covers.split()), sql)
        return fn

    return add


def load_all() -> dict[str, Query]:
    from freshet.queries import (  # noqa: F401
        dataset, evaluation, events, field, ingest, live, models, reporting, scenarios, series, spatial,
    )

    return REGISTRY
