"""Shared working folder and small column helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, ship, stored

#: ASCII white space, as a SQL regular-expression class body.
SPACE = r"\x20\x09-\x0D"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new name in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return scratch(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it.

    A lost executor costs no recomputation of what stands before the table.
    """
    return stored(df, name)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Make ready for functions in tasks: Arrow batches are bounded by rows and bytes, as long
    texts must not add up to hundreds of MB in a worker, and the workers get this package."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes for no column of ``docs`` to begin with it."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
