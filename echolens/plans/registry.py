"""Registry of reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tuned
from .tables import Tables, with_views

REPORTS: dict[str, Callable[[Tables], DataFrame]] = {}
TWINS: dict[str, str] = {}


def report(name: str, sql: str | None = None):
    def keep(build: Callable[[Tables], DataFrame]):
        REPORTS[name] = build
        if sql is not None:
            TWINS[name] = with_views(sql)
        return build

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build):
        return lambda spark, folder: build(Tables(tuned(spark), folder))

    return {name: bound(build) for name, build in REPORTS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
