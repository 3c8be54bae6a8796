"""Progress of streaming queries as rows: start, each batch, completion or failure."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..session import write_new

EVENT = "run_id string, place int, kind string, name string, batch bigint, input_rows bigint, error string, at string"


class ProgressSink(StreamingQueryListener):
    """Writes a small JSON file per event into a folder of the run: ``<path>/<run id>/<place>.json``.

    Kinds: stage_start, stage_progress (a batch), complete, error.  Events come from Spark's
    listener thread after the fact; ``wait`` returns when the last one of a run is written.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._places: dict[str, int] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _event(self, run_id: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run_id, threading.Event())

    def _write(self, run_id: str, kind: str, **values) -> None:
        with self._lock:
            place = self._places[run_id] = self._places.get(run_id, -1) + 1
        write_new(self.spark, f"{self.path}/{run_id}/{place:08d}.json", json.dumps({"run_id": run_id, "place": place, "kind": kind, **values}))

    def onQueryStarted(self, event) -> None:
        self._write(str(event.runId), "stage_start", name=event.name, at=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._write(str(p.runId), "stage_progress", name=p.name, batch=p.batchId, input_rows=p.numInputRows, at=p.timestamp)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run_id = str(event.runId)
        self._write(run_id, "error" if event.exception else "complete", error=event.exception)
        self._event(run_id).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        return self._event(str(query.runId)).wait(seconds)

    def rows(self) -> DataFrame:
        """EVENT rows of all runs so far."""
        return self.spark.read.schema(EVENT).option("recursiveFileLookup", "true").json(self.path)


def watched(spark: SparkSession, path: str, start) -> DataFrame:
    """Run ``start()`` (it starts a query and returns it) to its end under a sink; its event rows.

    A failure of the query isn't raised: it is the row of kind ``error``.
    """
    sink = ProgressSink(spark, path)
    spark.streams.addListener(sink)
    try:
        query = start()
        try:
            query.awaitTermination()
        except Exception:  # in the rows, by the listener
            if query.exception() is None:
                raise
        sink.wait(query)
    finally:
        spark.streams.removeListener(sink)
    return sink.rows()
