"""Query name to Spark query and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from obsmill.session import ship

Query = Callable[[SparkSession, str], DataFrame]
#: Modules with ``QUERIES`` (name to query) and ``SQL`` (name to oracle).
MODULES: tuple[str, ...] = ("observations", "catalog", "matching", "search", "relational")


def _plain(query: Query) -> Query:
    """Dates as text: engines hand them to Python as different types."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        df = query(spark, sf_dir)
        return df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "date"})

    return run


def queries() -> dict[str, Query]:
    return {name: _plain(query) for m in MODULES for name, query in import_module(f"obsmill.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"obsmill.plans.{m}").SQL.items()}
