"""Outputs of stages that several parts of an experiment need: computed once, found by what they depend on.

A stage's table lies under its name and the fingerprint of its parameters and inputs, so that a
run that asks for the same again reads it, and one with another parameter or a changed input
computes its own.  A table without its success mark is written anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import file_status


def fingerprint(parameters: dict[str, Any], digits: int = 16) -> str:
    """The first hex digits of the SHA-256 of the parameters as JSON with sorted keys; what JSON doesn't know goes in as its text."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode("utf-8")).hexdigest()[:digits]


def content_identity(rows: DataFrame, *columns: str) -> dict[str, Any]:
    """Count, sum and exclusive or of the rows' hashes: equal for equal rows in any order and any partitions."""
    h = F.xxhash64(*columns)
    n, total, mixed = rows.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return {"rows": n, "sum": str(total), "xor": str(mixed)}


def table_identity(spark: SparkSession, path: str) -> dict[str, Any]:
    """Path, bytes, files and time of a table on any store; no file is opened."""
    status = file_status(spark, path)
    if status is None:
        return {"path": path, "files": 0}
    at = status.getPath()
    summary = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at)
    return {"path": path, "bytes": summary.getLength(), "files": summary.getFileCount(), "changed": status.getModificationTime()}


class StageStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def once(self, stage: str, parameters: dict[str, Any], inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, built if it isn't there; ``inputs`` are the paths of the tables that it reads."""
        key = fingerprint({"stage": stage, "parameters": parameters, "inputs": [table_identity(self.spark, p) for p in inputs]})
        at = f"{self.path}/{stage}-{key}"
        if not file_status(self.spark, f"{at}/_SUCCESS"):
            build().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)


_store: ContextVar[StageStore | None] = ContextVar("stage_store", default=None)


@contextmanager
def shared_stages(store: StageStore) -> Iterator[StageStore]:
    """Plans that are put together inside take the outputs of their common stages from ``store``."""
    token = _store.set(store)
    try:
        yield store
    finally:
        _store.reset(token)


def stage(name: str, parameters: dict[str, Any], inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The stage's output from the store in force, else as a plan of its own."""
    store = _store.get()
    return build() if store is None else store.once(name, parameters, inputs, build)


def sharing() -> bool:
    return _store.get() is not None
