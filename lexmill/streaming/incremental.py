"""Incremental operators: windows with watermarks, deduplication and quotas with bounded state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import children, file_status, ship
from .keyed_log import KeyedLog


def stream_table(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of a Parquet table's files, some a batch.  A table that is one file is picked out of its folder."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    folder, name = path.rsplit("/", 1)
    stream = reader.option("pathGlobFilter", name).parquet(folder) if file_status(spark, path).isFile() else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream  # watermarks need an instant


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, exactly once, into a Parquet table, and read the table.

    The checkpoint beside the table makes a second call go on where the first ended.
    """
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def progress_windows(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    """window_start, event_type, n, total per tumbling window; ``late`` sets a watermark on a stream."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def within_quota(events: DataFrame, key: str, quota: int) -> DataFrame:
    """Events until their key's quota is reached.  State is a count per key, whatever the stream's length."""
    ship(events.sparkSession)

    def take(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        for b in batches:
            kept = b.iloc[: max(0, quota - seen)]
            seen += len(kept)
            if len(kept):
                yield kept
        state.update((seen,))

    return events.groupBy(key).applyInPandasWithState(take, events.schema, "seen bigint", "append", GroupStateTimeout.NoTimeout)


def earlier_within(later: DataFrame, earlier: DataFrame, key: str, span: str, late: str, late_earlier: str | None = None) -> DataFrame:
    """Each row of ``later`` with each row of ``earlier`` of the same key at most ``span`` before it, or at the same time.

    Both have key and ts; the other columns of ``earlier`` are named earlier_...  On streams both sides wait in state:
    a row is kept until the other side's watermark says that no partner can come any more, and rows
    older than their own watermark (``late``) are dropped.  On tables it is the plain join.
    """
    rest = [c for c in earlier.columns if c != key]
    e = earlier.withWatermark("ts", late_earlier or late).select(F.col(key).alias("earlier_key"), *(F.col(c).alias(f"earlier_{c}") for c in rest))
    near = (F.col(key) == F.col("earlier_key")) & (F.col("earlier_ts") <= F.col("ts")) & (F.col("earlier_ts") >= F.col("ts") - F.expr(f"INTERVAL {span}"))
    return later.withWatermark("ts", late).join(e, near).drop("earlier_key")


def put_if_absent(batch: DataFrame, path: str, key: str) -> None:
    """For foreachBatch: append rows whose key the log at ``path`` lacks, so a batch that runs twice adds nothing."""
    KeyedLog(batch.sparkSession, path, key).put(batch)


def shuffled_batches(stream: DataFrame, path: str, key: str, seed: int) -> DataFrame:
    """A stream's rows, each micro-batch in an order drawn from ``seed``, as a table with batch and place.

    The batch is the shuffle's buffer: a row's place is the hash of seed and key, and the
    batch is sorted by it in ranges, not in one task.  A batch that runs twice overwrites
    its own folder.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("place", F.xxhash64(F.lit(seed), key)).orderBy("place").write.mode("overwrite").parquet(f"{path}/table/batch={n}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    # A folder without its mark is a batch that broke off; the stream's next run writes it again.
    spark = stream.sparkSession
    whole = [p for p in children(spark, f"{path}/table") if file_status(spark, f"{p}/_SUCCESS")]
    return spark.read.option("basePath", f"{path}/table").parquet(*whole) if whole else spark.createDataFrame([], stream.schema.add("place", "long").add("batch", "int"))
