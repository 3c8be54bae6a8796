"""Streaming queries over the events, run over what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators.stages import content_identity, fingerprint
from ..session import scratch
from ..sources import corpus
from ..streaming import incremental as I
from ..streaming.keyed_log import KeyedLog
from ..streaming.progress import watched


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def progress_windows(spark, sf_dir):
    return I.progress_windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b, event_id FROM events),
 g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, min(ts) AS started, count(*) AS n FROM g GROUP BY user_id, g""")
def session_windows(spark, sf_dir):
    w = F.session_window("ts", "6 hours")
    return table(spark, sf_dir, "events").groupBy("user_id", w).agg(F.min("ts").alias("started"), F.count("*").alias("n")).select("user_id", "started", "n")


def _stream(spark, sf_dir):
    return I.stream_table(spark, f"{sf_dir}/events.parquet")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY ALL")
def stream_progress(spark, sf_dir):
    out = I.run_to_table(I.progress_windows(_stream(spark, sf_dir), late="1 hour"), scratch(spark, "stream-progress"))
    return out.select("window_start", "event_type", "n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedupe(spark, sf_dir):
    out = I.run_to_table(I.first_seen(_stream(spark, sf_dir), ["user_id", "event_type"], "60 days"), scratch(spark, "stream-dedupe"))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, least(count(*), 100) AS n FROM events GROUP BY event_type")
def stream_quota(spark, sf_dir):
    out = I.run_to_table(I.within_quota(_stream(spark, sf_dir), "event_type", 100), scratch(spark, "stream-quota"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT DISTINCT user_id FROM events)")
def stream_put_if_absent(spark, sf_dir):
    path = scratch(spark, "stream-cache")
    q = _stream(spark, sf_dir).select("user_id", "event_type").writeStream.foreachBatch(lambda b, _: I.put_if_absent(b, f"{path}/table", "user_id")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return KeyedLog(spark, f"{path}/table", "user_id").read().agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT a.event_id, a.user_id, b.event_id AS earlier_event_id, b.event_type AS earlier_event_type FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type <> 'click' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 1 HOUR")
def stream_earlier_events(spark, sf_dir):
    """Clicks joined to the user's other events of the hour before, two streams with state on both sides."""
    clicks = _stream(spark, sf_dir).where("event_type = 'click'").select("event_id", "user_id", "ts")
    others = _stream(spark, sf_dir).where("event_type <> 'click'").select("event_id", "user_id", "event_type", "ts")
    out = I.run_to_table(I.earlier_within(clicks, others, "user_id", "1 HOUR", "1 day"), scratch(spark, "stream-join"))
    return out.select("event_id", "user_id", "earlier_event_id", "earlier_event_type")


@query("SELECT 'stage_start' AS kind, 1::BIGINT AS n, NULL::BIGINT AS input_rows UNION ALL SELECT 'stage_progress', 1, count(*) FROM events UNION ALL SELECT 'complete', 1, NULL")
def stream_events_sink(spark, sf_dir):
    """The event rows of a run over the events; its batches have all their rows."""
    path = scratch(spark, "stream-events")
    stream = I.progress_windows(_stream(spark, sf_dir), late="1 hour")
    start = lambda: stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    events = watched(spark, f"{path}/events", start)
    read = events.where("kind <> 'stage_progress' or input_rows > 0")  # a batch without rows only moves the watermark
    return read.groupBy("kind").agg(F.count("*").alias("n"), F.sum("input_rows").alias("input_rows"))


@query("SELECT doc_id, source, 'doc:' || doc_id AS url, length(text) AS n_chars, sha256(text) AS sha256 FROM documents")
def document_stream(spark, sf_dir):
    """The documents written as a file each, and read back as streams of 400 a batch."""
    path = scratch(spark, "document-stream")
    docs = table(spark, sf_dir, "documents")
    log = corpus.write_documents(docs, path, F.col("source"), F.concat(F.lit("doc:"), "doc_id"), F.col("text"))
    read = corpus.run_log(spark, log, f"{path}/table", f"{path}/checkpoint", 400)
    return read.select(F.substring_index("url", ":", -1).cast("bigint").alias("doc_id"), "source", "url", F.length("content").cast("bigint").alias("n_chars"), F.sha2("content", 256).alias("sha256"))


@query("""WITH c AS (SELECT turn % 2 AS batch, conv_id, turn, trim(text) AS item FROM conversations), s AS (SELECT *, row_number() OVER (PARTITION BY sha256(item) ORDER BY batch, conv_id, turn) AS nth, length(item) >= 20 AS ok FROM c)
SELECT batch, CASE WHEN NOT ok THEN 'too short' WHEN nth > 1 THEN 'seen' ELSE 'new' END AS reason, count(*) AS n FROM (SELECT batch, ok, row_number() OVER (PARTITION BY ok, sha256(item) ORDER BY batch, conv_id, turn) AS nth FROM s) GROUP BY ALL""")
def batch_cache(spark, sf_dir):
    """Two batches of turns put into a content-addressed log, the second twice; why items came in or not."""
    log = KeyedLog(spark, scratch(spark, "batch-cache"), "item_hash")
    turns = table(spark, sf_dir, "conversations").select((F.col("turn") % 2).alias("batch"), "conv_id", "turn", F.trim("text").alias("item"))
    turns = turns.withColumn("item_hash", F.sha2("item", 256))
    good = turns.where(F.length("item") >= 20)
    for b in (0, 1, 1):
        rows = good.where(F.col("batch") == b)
        log.put(rows, fingerprint({"stage": "turns", "least": 20, **content_identity(rows, "conv_id", "turn", "item_hash")}), [F.col("conv_id"), F.col("turn")])
    held = log.read()
    new = turns.limit(0).select("batch", "conv_id", "turn") if held is None else held.select("batch", "conv_id", "turn")
    judged = turns.join(new.withColumn("new", F.lit(True)), ["batch", "conv_id", "turn"], "left")
    reason = F.when(F.length("item") < 20, "too short").when(F.col("new"), "new").otherwise("seen")
    return judged.groupBy("batch", reason.alias("reason")).agg(F.count("*").alias("n"))
