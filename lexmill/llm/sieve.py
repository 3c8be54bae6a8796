"""A Bloom filter of fixed size over integer ids: a sieve before an exact join.

A join of texts with a short list of ids would shuffle every text.  The sieve is a few
megabytes whatever the list's length (``BITS`` bits), so it can be sent to the tasks;
texts that can't be in the list are settled where they stand, and only the others go on
to the join that decides.  A list too long for it lets more through and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import small_batches

BITS, PROBES = 1 << 25, 4


def _places(ids: np.ndarray) -> np.ndarray:
    """PROBES bit numbers of each id, as rows."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] + np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & np.uint64(BITS - 1)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = np.unique(_places(b.column(0).drop_null().to_numpy()))
        word, first = np.unique(at >> np.uint64(5), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(31)), first) if len(at) else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.astype(np.int64))], ["word", "bits"])


class Sieve:
    def __init__(self, ids: DataFrame, column: str) -> None:
        spark = ids.sparkSession
        small_batches(spark)
        found = ids.select(F.col(column).cast("bigint")).mapInArrow(_marks, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # BITS / 32 rows at most
        table = np.zeros(BITS // 32, np.uint32)
        table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
        self.sent = spark.sparkContext.broadcast(table)

    def column(self, ids: Column) -> Column:
        """False where the id is surely not in the list."""
        sent = self.sent

        @F.pandas_udf("boolean")
        def test(s: pd.Series) -> pd.Series:
            out = np.zeros(len(s), bool)
            there = s.notna().to_numpy()
            out[there] = may_hold(sent.value, s[there].to_numpy().astype(np.int64))
            return pd.Series(out)

        return test(ids.cast("bigint"))


def may_hold(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _places(ids)
    return ((table[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & 1).all(1)
