"""Pinned documents as table and stream, the keyed log, the stage store, progress rows, joins of streams."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.operators import retrieval, stages
from lexmill.sources import corpus
from lexmill.streaming import incremental as I
from lexmill.streaming.keyed_log import KeyedLog
from lexmill.streaming.progress import watched


def pins_at(folder, n, sources=3):
    out = []
    for i in range(n):
        (folder / f"d{i}.txt").write_text(f"text {i}")
        out.append({"source": f"s{i % sources}", "url": f"http://h{i % 2}/{i}", "path": f"file://{folder}/d{i}.txt"})
    return out


def test_predicates_choose_the_files_that_are_opened(spark, tmp_path):
    good = pins_at(tmp_path, 6)
    poison = [{"source": "bad", "url": "http://x/1", "path": {"not": "a path"}}]  # opening it would fail the query
    df = corpus.pinned(spark, good + poison)
    with pytest.raises(Exception, match="(?i)error|type"):
        df.collect()
    one = df.where("source = 's1'")
    assert sorted(r["url"] for r in one.collect()) == ["http://h0/4", "http://h1/1"] and one.rdd.getNumPartitions() == 2
    some = df.where(F.col("source").isin("s0", "s2") & F.col("url").startswith("http://h0"))
    assert sorted(r["content"] for r in some.collect()) == ["text 0", "text 2"] and some.rdd.getNumPartitions() == 2
    assert df.where("source = 'none'").count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PythonScan" in plan or "BatchScan" in plan
    # A predicate on the content isn't pushed and still holds.
    assert [r["url"] for r in df.where("source <> 'bad' and source = 's0' and content = 'text 3'").collect()] == ["http://h1/3"]


def test_document_stream_reads_each_once_over_restarts(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "log").mkdir()
    pins = pins_at(tmp_path / "docs", 25)
    pins[7]["path"] = f"file://{tmp_path}/missing"
    lines = [json.dumps(p) for p in pins]
    (tmp_path / "log" / "000.json").write_text("\n".join(lines[:10]) + "\n")
    (tmp_path / "log" / "001.json").write_text("\n".join(lines[10:13]) + "\n\n")
    log, out, state = f"file://{tmp_path}/log", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    # The first run breaks off in its second batch: the batch is logged, not committed.
    seen = []

    def fail_second(batch, n):
        if n == 1 and not seen:
            seen.append(n)
            raise RuntimeError("stop")
        batch.write.mode("append").parquet(f"{out}/batch={n}") if n == 0 else batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    def run():
        q = corpus.document_stream(spark, log, state, most=4, per_task=3).writeStream.foreachBatch(fail_second).option("checkpointLocation", state).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="stop"):
        run()
    run()
    (tmp_path / "log" / "002.json").write_text("\n".join(lines[13:]) + "\n")
    run()
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["url"] for r in rows) == sorted(p["url"] for p in pins)
    assert {r["url"]: r["content"] for r in rows}["http://h0/8"] == "text 8"
    assert [r["url"] for r in rows if r["error"]] == ["http://h1/7"]
    sizes = {r["batch"]: r["count"] for r in spark.read.parquet(out).groupBy("batch").count().collect()}
    assert max(sizes.values()) == 4 and len(sizes) == 7


def test_streams_side_by_side_read_a_log_once_over_restarts(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "log").mkdir()
    pins = pins_at(tmp_path / "docs", 25)
    lines = [json.dumps(p) for p in pins]
    log, out, state = f"file://{tmp_path}/log", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    run = lambda: corpus.run_log(spark, log, out, state, most=3, shards=3)
    assert run().columns == ["source", "url", "content", "error"] and run().count() == 0
    (tmp_path / "log" / "000.json").write_text("\n".join(lines[:2]) + "\n")
    assert sorted(r["url"] for r in run().collect()) == sorted(p["url"] for p in pins[:2])
    (tmp_path / "log" / "001.json").write_text("\n" + "\n".join(lines[2:15]) + "\n")
    run()
    (tmp_path / "log" / "001.json").write_text("\n" + "\n".join(lines[2:20]) + "\n")  # the last file grows
    (tmp_path / "log" / "002.json").write_text("\n".join(lines[20:]))
    run()
    rows = run().collect()
    assert sorted(r["url"] for r in rows) == sorted(p["url"] for p in pins) and all(r["content"] for r in rows)
    batches = [len(list((tmp_path / "state" / str(k) / "commits").glob("[0-9]*"))) for k in range(3)]
    assert min(batches) >= 3 and sum(batches) >= -(-25 // 3)  # each has a part, three a batch at most


def test_batches_in_a_log_file_read_it_once(tmp_path):
    (tmp_path / "a.json").write_text("".join(json.dumps({"url": str(i)}) + "\n" for i in range(100)))
    log, opens = corpus.PinLog(str(tmp_path), 1, 4), []

    class Counted:
        def __init__(self, system):
            self.get_file_info, self.system = system.get_file_info, system

        def open_input_stream(self, path):
            opens.append(path)
            return self.system.open_input_stream(path)

    log.system = Counted(log.system)
    at, got = corpus.START, []
    while batch := [x for _, x in zip(range(7), log.after(at), strict=False)]:
        got += [pin["url"] for _, pin in batch]
        at = batch[-1][0]
    assert got == [str(i) for i in range(1, 100, 4)] and len(opens) == 1
    with (tmp_path / "a.json").open("a") as f:
        f.write("\n" + json.dumps({"url": "late"}) + "\n")
    assert [pin["url"] for _, pin in log.after(at)] == ["late"] and len(opens) == 2


def test_written_documents_come_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x\ny é"), (2, None, None), (3, "b", "")], "id int, s string, t string")
    log = corpus.write_documents(docs, f"file://{tmp_path}/w", F.col("s"), F.concat(F.lit("u"), "id"), F.col("t"))
    corpus.run_documents(corpus.document_stream(spark, log, f"file://{tmp_path}/c"), f"file://{tmp_path}/t", f"file://{tmp_path}/c")
    got = {r["url"]: (r["source"], r["content"], r["error"]) for r in spark.read.parquet(f"file://{tmp_path}/t").collect()}
    assert got == {"u1": ("a", "x\ny é", None), "u2": (None, "", None), "u3": ("b", "", None)}


def events_at(spark, path, name, rows):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, u, k, t0 + timedelta(minutes=m)) for i, u, k, m in rows], "event_id int, user_id int, event_type string, ts timestamp")
    df.coalesce(1).write.mode("append").parquet(f"file://{path}/{name}")


def test_interval_join_of_streams_drops_late_rows(spark, tmp_path):
    """The second file moves the watermark past a row of the third, which finds no partner any more."""
    schema = "event_id int, user_id int, event_type string, ts timestamp"
    src = tmp_path / "src"
    events_at(spark, src, "a", [(1, 1, "view", 0), (2, 1, "click", 30), (3, 1, "click", 61), (4, 2, "view", 10), (5, 2, "view", 200)])

    def run():
        read = lambda kind: spark.readStream.schema(schema).parquet(f"file://{src}/*").where(F.col("event_type") == kind)
        out = I.earlier_within(read("click").select("event_id", "user_id", "ts"), read("view").select("event_id", "user_id", "ts"), "user_id", "1 HOUR", "5 minutes")
        return sorted((r["earlier_event_id"], r["event_id"]) for r in I.run_to_table(out, f"file://{tmp_path}/out").collect())

    assert run() == [(1, 2)]
    events_at(spark, src, "b", [(6, 3, "view", 1000), (7, 3, "click", 1000), (8, 1, "click", 58)])  # 8 lies behind 3 but not behind the watermark
    assert run() == [(1, 2), (1, 8), (6, 7)]
    events_at(spark, src, "c", [(9, 3, "click", 30), (10, 3, "view", 20), (11, 3, "click", 1030)])
    got = run()
    assert got == [(1, 2), (1, 8), (6, 7), (6, 11)]  # 9 and 10 lie before the watermark: on tables they would be a pair
    table = spark.read.schema(schema).parquet(f"file://{src}/*")
    plain = I.earlier_within(table.where("event_type = 'click'").select("event_id", "user_id", "ts"), table.where("event_type = 'view'").select("event_id", "user_id", "ts"), "user_id", "1 HOUR", "5 minutes")
    assert sorted((r["earlier_event_id"], r["event_id"]) for r in plain.collect()) == sorted([*got, (10, 9)])


def rows_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v int")


def held(log):
    return sorted((r["k"], r["v"]) for r in log.read().collect())


def test_log_keeps_the_first_row_of_a_key(spark, tmp_path):
    log = KeyedLog(spark, f"file://{tmp_path}/l", "k", buckets=8)
    assert log.read() is None
    assert log.put(rows_of(spark, ("a", 1), ("b", 2), ("b", 1), (None, 5)), order=[F.col("v")]) == 2
    assert log.put(rows_of(spark, ("a", 9), ("c", 3))) == 1
    assert log.put(rows_of(spark, ("a", 9))) == 0
    assert held(log) == [("a", 1), ("b", 1), ("c", 3)]
    assert log.compact() == 3 and held(log) == [("a", 1), ("b", 1), ("c", 3)] and len(log.marks()) == 1
    assert log.put(rows_of(spark, ("c", 0), ("d", 4))) == 1 and len(held(log)) == 4


def test_a_batch_runs_once_for_its_identity(spark, tmp_path):
    log, batch = KeyedLog(spark, f"file://{tmp_path}/l", "k", 4), rows_of(spark, ("a", 1), ("b", 2))
    identity = stages.fingerprint({"model": "m", **stages.content_identity(batch, "k", "v")})
    assert stages.fingerprint({**stages.content_identity(batch.repartition(3).orderBy(F.desc("k")), "k", "v"), "model": "m"}) == identity
    assert (log.put(batch, identity), log.put(batch, identity)) == (2, 0) and len(log.marks()) == 1
    log.put(rows_of(spark, ("c", 1)), "other")
    log.compact()
    assert log.put(rows_of(spark, ("z", 1)), identity) == 0  # known through the compaction too


def test_a_killed_writer_leaves_nothing_visible(spark, tmp_path):
    log = KeyedLog(spark, f"file://{tmp_path}/l", "k", 4)
    log.put(rows_of(spark, ("a", 1)))
    rows_of(spark, ("x", 1), ("a", 7)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"file://{tmp_path}/l/gen=1")  # written, never marked
    assert held(log) == [("a", 1)]
    assert log.put(rows_of(spark, ("b", 2))) == 1 and held(log) == [("a", 1), ("b", 2)]


def test_a_put_opens_the_buckets_it_touches(spark, tmp_path):
    log = KeyedLog(spark, f"file://{tmp_path}/l", "k", buckets=32)
    log.put(rows_of(spark, *((f"k{i}", i) for i in range(300))))
    keys = rows_of(spark, ("k7", 0)).withColumn("bucket", log._bucket())
    known = log.known(keys)
    bucket = keys.first()["bucket"]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert f"bucket#" in plan and f"({bucket})" in plan.split("PartitionFilters")[1].split("]")[0] or f"= {bucket}" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "ReadSchema: struct<k:string>" in plan
    assert {f"bucket={bucket}" in r[0] for r in known.select(F.input_file_name()).distinct().collect()} == {True}


def test_fingerprint_is_the_documented_rule():
    payload = {"tau": 0.376, "a": [1, {"z": None, "b": True}], "when": datetime(2024, 1, 2)}
    assert stages.fingerprint(payload) == hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode("utf-8")).hexdigest()[:16]
    assert stages.fingerprint({"b": 1, "a": 2}) == stages.fingerprint({"a": 2, "b": 1}) != stages.fingerprint({"a": 2, "b": 2})


def test_a_stage_is_built_once_for_parameters_and_inputs(spark, tmp_path):
    source, built = f"file://{tmp_path}/in", []
    spark.range(3).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source).withColumn("x", F.col("id") + 1)

    with stages.shared_stages(stages.StageStore(spark, f"file://{tmp_path}/store")):
        ask = lambda k: stages.stage("plus", {"k": k}, [source], build).count()
        assert (ask(1), ask(1), len(built)) == (3, 3, 1)
        assert (ask(2), len(built)) == (3, 2)
        spark.range(2).write.mode("append").parquet(source)
        assert (ask(1), len(built)) == (5, 3)
    assert stages.stage("plus", {"k": 1}, [source], build).count() == 5 and len(built) == 4  # no store in force


def test_progress_rows_of_a_run_and_of_a_failure(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(src)
    read = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
    start = lambda: read.writeStream.queryName("good").format("noop").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c1").start()
    rows = watched(spark, f"file://{tmp_path}/e1", start).orderBy("place").collect()
    assert [r["kind"] for r in rows] == ["stage_start", *["stage_progress"] * 3, "complete"]
    assert [r["input_rows"] for r in rows[1:-1]] == [10, 10, 10] and [r["batch"] for r in rows[1:-1]] == [0, 1, 2] and rows[0]["name"] == "good"
    bad = lambda: read.select(F.raise_error(F.lit("broken row"))).writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c2").start()
    rows = watched(spark, f"file://{tmp_path}/e2", bad).orderBy("place").collect()
    assert rows[0]["kind"] == "stage_start" and rows[-1]["kind"] == "error" and "broken row" in rows[-1]["error"]


def test_a_broken_batch_of_the_shuffle_is_not_read(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    spark.range(20).write.parquet(src)
    stream = spark.readStream.schema("id long").parquet(src)
    assert I.shuffled_batches(stream, out, "id", 1).count() == 20
    spark.range(5).withColumn("place", F.lit(1).cast("long")).write.parquet(f"{out}/table/batch=9")
    (tmp_path / "out" / "table" / "batch=9" / "_SUCCESS").unlink()
    assert I.shuffled_batches(stream, out, "id", 1).count() == 20


def test_short_passages_are_found_like_long_ones(spark):
    texts = ["the fee is ten euros a year", "fee is", "prefee isle", "coffee is tender", "a b c d e f g h", "", "x fee is ten y", "b c d e f"]
    asked = ["fee is", "fee is ten", "e is ten", "b c d e f", "a b c d e f g h", "fee", "c", " ", "c d e f g"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "q_id int, text string")
    want = {(i, j) for i, a in enumerate(asked) if a.split() for j, t in enumerate(texts) if a in t}
    assert {tuple(r) for r in retrieval.holding(q, d).select("q_id", "doc_id").collect()} == want


def test_ranks_are_filled_up_with_the_first_documents(spark):
    d = spark.createDataFrame([(i, "alpha" if i % 4 == 0 else "beta") for i in range(40)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "none")], "q_id int, text string")
    got = {}
    for r in retrieval.bm25(q, d, fill_zero=15).orderBy("q_id", "rank").collect():
        got.setdefault(r["q_id"], []).append(r["doc_id"])
    assert got[1][:15] == [*range(0, 40, 4), 1, 2, 3, 5, 6] and len(got[2]) == 30 and got[3][:15] == list(range(15))


def test_a_batch_reads_no_pins_behind_its_end(tmp_path, monkeypatch):
    """Each batch read the rest of the log, so the whole took the square of its length."""
    from lexmill.sources import corpus

    (tmp_path / "a.json").write_text("".join(json.dumps({"source": "s", "url": f"u{i}", "path": "p"}) + "\n" for i in range(1000)))
    reader, read = corpus._LogReader(str(tmp_path), None, 10, 4), []
    loads = json.loads
    monkeypatch.setattr(corpus.json, "loads", lambda x: read.append(x) or loads(x))
    parts = reader.partitions({"file": "a.json", "line": 20}, {"file": "a.json", "line": 30})
    assert [[p["url"] for p in x.pins] for x in parts] == [["u20", "u21", "u22", "u23"], ["u24", "u25", "u26", "u27"], ["u28", "u29"]]
    assert len(read) <= 11
