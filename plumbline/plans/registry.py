"""The catalogue of registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.views import with_views

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFunction
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, views: str = "") -> Callable[[QueryFunction], QueryFunction]:
    """Register a function under its own name, with the SQL that gives the same rows."""

    def register(run: QueryFunction) -> QueryFunction:
        name = run.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(run, with_views(views, sql) if sql and views else sql)
        return run

    return register
