"""Manifests, sinks, checks and small functions on literal rows and files."""

from __future__ import annotations

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import gates as G
from lexmill.sources import files, manifests, sinks
from lexmill.streaming import incremental as I


def test_contract_clauses_of_both_shapes(spark):
    rows = spark.createDataFrame(
        [("k1", "f.pdf", "T", " a b c d e ", "Fee", None, None), ("k2", None, "T2", " ", None, "Why?", (["one two three", "one two three four five", None],)), (None, None, None, "v w x y z", None, None, None), ("k4", None, None, None, None, None, None)],
        "id string, file_name string, title string, clause string, label string, question string, answers struct<text:array<string>>",
    )
    got = {r["source_id"]: tuple(r)[1:4] for r in manifests.contract_clauses(rows, "cc", "train").collect()}
    direct = next(k for k in got if k.startswith("clause-"))
    assert got == {"f.pdf": ("f.pdf", "a b c d e", "Fee"), "k2::1": ("T2", "one two three four five", "Why?"), direct: ("unknown", "v w x y z", "")}
    assert manifests.contract_clauses(rows, "cc", "train", limit=2).count() == 2
    assert manifests.contract_clauses(rows.select("id").limit(0), "cc", "train").count() == 0


def test_parser_gold_of_csv_and_json(spark, tmp_path):
    with open(tmp_path / "g.csv", "w", newline="") as f:
        csv.writer(f).writerows([("path", "gold_clause"), ("b", "z, \"quoted\""), ("a", "x"), ("b", " y "), ("b", ""), ("", "lost")])
    assert dict(map(tuple, manifests.parser_gold(spark, str(tmp_path / "g.csv")).collect())) == {"b": ['z, "quoted"', "y"], "a": ["x"]}
    (tmp_path / "g.json").write_text(json.dumps([{"path": "a", "gold_clauses": ["x", "y"]}]))
    assert [tuple(r) for r in manifests.parser_gold(spark, str(tmp_path / "g.json")).collect()] == [("a", ["x", "y"])]
    (tmp_path / "bad.json").write_text(json.dumps([{"path": "a"}]))
    with pytest.raises(Exception, match="gold_clauses"):
        manifests.parser_gold(spark, str(tmp_path / "bad.json")).collect()


def test_candidates(spark):
    schema = "source_id string, document_id string, risk_label string, text string, human_reviewed boolean, excluded_from_training boolean, n int"
    t = "one two three four five six seven eight"
    gold = [("s1", None, "hidden-fee", t, True, True, 2), ("s1", "d", "SAFE", t, True, True, 1), ("s2", "d", "Safe", t, None, True, 3), ("s3", "d", "Safe", "short", True, True, 4), (None, "d", "Safe", t, True, True, 5), ("s4", "d", "none", t, True, True, 6)]
    silver = [("s1", "d9", "Safe", t, False, True, 0), ("s5", " ", "Hidden Fee", t, False, True, 1), ("s6", "d", "Safe", t, False, False, 2)]
    got = manifests.candidates([("gold", spark.createDataFrame(gold, schema), True), ("silver", spark.createDataFrame(silver, schema), False)], ["Hidden Fee", "Safe"], "n")
    assert sorted(tuple(r) for r in got.drop("text").collect()) == [("s1", "d", "Safe", "gold"), ("s5", "s5", "Hidden Fee", "silver")]


def test_document_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("path,lang,scan_quality\na/b.txt,en,\n/abs.txt,de,good\ns3://x/y.txt,fr,poor\n")
    got = {r["path"]: r["metadata"] for r in manifests.document_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert set(got) == {f"{tmp_path}/a/b.txt", "/abs.txt", "s3://x/y.txt"} and got["/abs.txt"] == {"lang": "de", "scan_quality": "good"}
    (tmp_path / "m.json").write_text(json.dumps([{"path": "x.txt", "pages": 3}]))
    row = manifests.document_manifest(spark, f"file://{tmp_path}/m.json").first()
    assert row["path"] == f"file://{tmp_path}/x.txt" and row["metadata"] == {"pages": "3"}


def test_by_dimension_leaves_failed_documents_out(spark):
    rows = [("ok", {"document_type": "loan"}, 2.0, None), ("ok", {"document_type": ""}, None, 1.0), ("error", {"document_type": "loan"}, 9.0, 9.0), ("ok", None, None, None)]
    d = spark.createDataFrame(rows, "status string, metadata map<string,string>, fk double, faith double")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in manifests.by_dimension(d, ["fk", "faith"]).collect()}
    assert got["document_type", "loan"] == (1, 2.0, None) and got["document_type", "unspecified"] == (1, None, 1.0) and got["length_band", "unspecified"] == (1, 2.0, 1.0)


def test_report_stems(spark):
    names = [("/in/a.b.pdf",), ("c:\\x\\y.docx",), (".hidden",), ("x" * 90 + ".pdf",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(names, "f string").select(sinks.report_stem("f")).collect()]
    assert got == ["a.b", "y", ".hidden", "x" * 80, "document", "document"]


def test_result_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", 'say "x", y'), ("a", "p|q\nr"), ("c", None)], "section string, value string")
    sinks.write_results(rows, str(tmp_path), ["section"], "Results")
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/markdown/part-*")))
    assert text.splitlines() == ["# Results", "", "| section | value |", "| --- | --- |", "| a | p\\|q r |", '| b | say "x", y |', "| c |  |"]
    back = spark.read.csv(f"{tmp_path}/csv", header=True, escape='"', multiLine=True).collect()
    assert sorted(map(tuple, back), key=str) == sorted(map(tuple, rows.collect()), key=str)
    sinks.write_json_lines(rows, f"{tmp_path}/lines")
    assert {"section": "c", "value": None} in [json.loads(x) for f in glob.glob(f"{tmp_path}/lines/part-*") for x in open(f)]


def test_acceptance_and_preflight(spark):
    plan = spark.createDataFrame([(None, 42, "other", ["a", "b", "a"])], "accepted boolean, seed int, taxonomy_sha256 string, labels array<string>")
    assert dict(map(tuple, G.plan_acceptance(plan, 42, F.lit("sha"), ["b", "a"]).collect())) == {"accepted": False, "seed": True, "taxonomy": False, "labels": True}
    facts = spark.createDataFrame([(1, None)], "x int, y int")
    warned = G.preflight(facts, {"x": ("error", F.col("x") == 1), "y": ("warning", F.col("y") == 1)}).collect()
    assert [tuple(r) for r in warned] == [("x", "error", True, True), ("y", "warning", False, True)]
    assert not G.preflight(facts, {"y": ("error", F.col("y") == 1)}).first()["ready"]


def test_picked_evidence(spark):
    rows = spark.createDataFrame([("a", ["a"], True), ("b", ["a"], True), (None, ["a"], True), ("a", None, True), ("a", ["a"], None)], "id string, pool array<string>, ok boolean")
    assert [tuple(r) for r in G.picked_evidence(rows, "id", "pool", "ok").select("id", "ok").collect()] == [("a", True), (None, False), (None, False), (None, False), ("a", False)]


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    array = lambda *x: F.array(*map(F.lit, x))
    assert one(X.subset_of(array(1, 1), array(1, 2))) and not one(X.subset_of(array(3), array(1))) and one(X.subset_of(array(), array(1)))
    assert one(X.subset_of(F.lit(None).cast("array<int>"), array(1))) is None
    assert one(X.int_grid(F.lit("5, 3,x,-1,5,0,"))) == [3, 5] and one(X.comma_list(F.lit(" a ,, b"))) == ["a", "b"]
    assert one(X.string_map(F.lit('{"a": "1", "": "x", "b": null}'))) == {"a": "1"} and one(X.string_map(F.lit("[1]"))) in (None, {})
    assert one(X.iso_utc(F.lit("2024-02-29 23:59:58.9+02:00"))) == "2024-02-29T21:59:58+00:00"
    assert one(X.elapsed_ms(F.lit("2024-01-01 00:00:00"), F.lit("2024-01-01 00:00:01.2345"))) == 1234.5


def test_first_metric(spark):
    cases = {'{"a": {"f1": 1}, "f1": 2}': 2.0, '{"a": [{"b": 0}, {"f1": 3}], "c": {"f1": 4}}': 3.0, '{"f1": "x"}': None, "[": None, "7": None, '{"acc": 5, "f1": 6}': 6.0}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", files.first_metric(F.col("t"), ["f1", "acc"]).alias("x"))
    assert {r["t"]: r["x"] for r in rows.collect()} == cases


def test_shuffled_batches(spark, sf, tmp_path):
    s = I.stream_table(spark, f"{sf}/events.parquet")
    a = I.shuffled_batches(s, f"{tmp_path}/a", "event_id", 1)
    b = I.shuffled_batches(s, f"{tmp_path}/b", "event_id", 2)
    order = lambda t: [r[0] for r in t.orderBy("batch", "place").select("event_id").collect()]
    assert sorted(order(a)) == sorted(order(b)) == sorted(r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect())
    assert order(a) != order(b) != sorted(order(b))
