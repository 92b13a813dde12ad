"""All registered queries and their SQL, gathered from the families in ``issuetime.plans``."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from issuetime import schemas

FAMILIES = ("targets", "joins", "aggregates", "frames", "weather", "scoring", "selection", "events", "scans", "models", "streams", "evidence", "datasets", "ledger", "forecasters", "transport", "states", "policies", "channels")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False, inputs: bool = True):
    """Register a query under ``name``, with its DuckDB body over the shared inputs if SQL can express it."""

    def add(f):
        _queries[name] = f
        if sql:
            _sql[name] = schemas.sql(sql, recursive) if inputs else sql
        return f

    return add


def _load() -> None:
    for family in FAMILIES:
        import_module(f"issuetime.plans.{family}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from issuetime.plans.targets import change_report

    return change_report(spark, sf_dir, schemas.SMOKE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
