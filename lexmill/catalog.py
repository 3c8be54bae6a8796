"""Name -> (DataFrame builder, SQL) of the library's queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

MODULES = ("text", "retrieval", "evaluation", "resampling", "benchmark", "contracts", "ingestion", "streams", "gates", "composite", "artefacts", "answers", "whole")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a builder under its name; ``sql`` gives the same rows from the same tables."""

    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for m in MODULES:
        import_module(f"lexmill.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold each benchmark passage: lexical top-k with retrieval metrics."""
    return queries()["multi_gold_retrieval_metrics"](spark, sf_dir)
