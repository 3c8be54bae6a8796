"""A content-addressed, append-only log of rows, one per key.

Rows lie in generations (one a batch) and, in these, in buckets by the hash of their key:
``gen=<n>/bucket=<b>``.  A batch reads only the buckets that its own keys fall into, and of
these only the keys.  A generation counts once its mark stands in ``_marks``; what a writer
that broke off has left has no mark, isn't read, and is written over.  Compaction writes all
generations as one, with the first row of each key, and its mark replaces theirs.

A batch can carry an identity (parameters and the hashes of its rows).  A batch whose identity
is marked already isn't run again.  Rows without a key aren't kept.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import children, stored, write_new

BUCKETS = 64


class KeyedLog:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def marks(self) -> dict[int, dict]:
        """Generation -> its mark; those that a compaction has replaced are left out."""
        paths = [p for p in children(self.spark, f"{self.path}/_marks") if re.search(r"/\d+$", p)]
        rows = self.spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).cast("int"), "value").collect() if paths else []  # a row a batch
        found = {n: json.loads(v) for n, v in rows}
        gone = max((m["replaces"] for m in found.values() if "replaces" in m), default=-1)
        return {n: m for n, m in sorted(found.items()) if n > gone}

    def read(self) -> DataFrame | None:
        """The rows of the marked generations with gen and bucket, the partition columns; None if there are none."""
        paths = [f"{self.path}/gen={n}" for n, m in self.marks().items() if m["rows"]]
        return self.spark.read.option("basePath", self.path).parquet(*paths) if paths else None

    def known(self, keys: DataFrame) -> DataFrame:
        """The keys of ``keys`` (with bucket) that the log holds; other buckets' files aren't opened."""
        touched = sorted(r[0] for r in keys.select("bucket").distinct().collect())  # the number of buckets at most
        held = self.read()
        return keys.limit(0).select(self.key) if held is None else held.where(F.col("bucket").isin(touched)).select(self.key)

    def put(self, batch: DataFrame, identity: str | None = None, order: list[Column] | None = None) -> int:
        """Append the rows of new keys, the first by ``order`` of each; returns how many.  Runs once for an identity."""
        marks = self.marks()
        if identity is not None and any(identity in (m["identity"], *m.get("identities", [])) for m in marks.values()):
            return 0
        rows = batch.where(F.col(self.key).isNotNull()).withColumn("bucket", self._bucket())
        if order:
            rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", self.key).orderBy(*order))).where("nth = 1").drop("nth")
        else:
            rows = rows.dropDuplicates([self.key])
        rows = stored(rows, "log-batch")
        fresh = rows.join(self.known(rows), self.key, "left_anti")
        return self._write(fresh, max([*marks, *self._taken()], default=-1) + 1, {"identity": identity})

    def _taken(self) -> list[int]:
        return [int(p.rsplit("/", 1)[1]) for p in children(self.spark, f"{self.path}/_marks") if re.search(r"/\d+$", p)]

    def _write(self, rows: DataFrame, gen: int, mark: dict) -> int:
        target = f"{self.path}/gen={gen}"
        rows.write.mode("overwrite").partitionBy("bucket").parquet(target)  # over what a broken writer has left
        n = self.spark.read.schema(rows.schema).parquet(target).count()
        if not write_new(self.spark, f"{self.path}/_marks/{gen}", json.dumps({"rows": n, **mark})):
            raise RuntimeError(f"another writer has marked generation {gen}")
        return n

    def compact(self) -> int:
        """All generations as one: of each key the row of its first generation.  Returns the rows."""
        marks, held = self.marks(), self.read()
        if held is None:
            return 0
        first = Window.partitionBy("bucket", self.key).orderBy("gen")
        rows = held.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "gen")
        known = [i for m in marks.values() for i in (m["identity"], *m.get("identities", [])) if i]
        return self._write(rows, max(self._taken()) + 1, {"identity": None, "replaces": max(marks), "identities": known})
