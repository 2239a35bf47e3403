"""Every registered query of the corpus jobs, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import row_plans, search_plans, table_plans

Query = Callable[[SparkSession, str], DataFrame]
_PLANS: dict[str, tuple[Query, str | None]] = row_plans.PLANS | table_plans.PLANS | search_plans.PLANS


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _PLANS.items() if sql}
