"""All queries of the reference's own operators, by name, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "retrieval_kld"
_MODULES = ("counters", "text", "retrieval", "mining", "numeric", "io", "feedback", "more")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables as the query of its name."""

    def take(f):
        _queries[f.__name__] = lambda spark, path: f(Tables(spark, path))
        if sql:
            _sql[f.__name__] = sql
        return f

    return take


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"lexarium.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
