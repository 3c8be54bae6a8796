"""The pinned corpus, model stand-ins and gates on literal rows."""

from __future__ import annotations

import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.operators import gates, models
from lexmill.sources import corpus, files, normalise
from lexmill.streaming import incremental
from lexmill.streaming.keyed_log import KeyedLog


NLI_ROWS = [
    ("a", "Q: May it be shared?\n\nContext: It may not be shared.", "Contradiction", None, None, None, None, None),
    ("b", None, None, "Fees are due monthly.", "Fees are due.", "1", None, None),
    ("c", None, None, "Fees are due monthly.", None, None, ["Fees exist.", "There are no fees.", " "], ["Entailment", "contradiction", None]),
    ("d", "No marker here", "entailed", None, None, None, None, None),
    ("e", None, None, "Fees are due monthly.", "Fees are due.", "entailment", None, None),
]
NLI_SCHEMA = "id string, input string, output string, premise string, hypothesis string, label string, hypotheses array<string>, labels array<string>"
QA_SCHEMA = "id string, question string, answer string, doc_name string, evidence_text string, evidence_lists struct<text:array<string>,doc_name:array<string>,page:array<string>>, evidence_items array<struct<text:string,doc_name:string,page:string>>"
QA_ROWS = [
    ("q1", "What fee?", "Ten.", "d1", "The fee is ten.", None, None), ("q2", "When?", "May.", None, None, (["Due in May.", "Late fees apply."], ["d2"], ["7", "x"]), None),
    ("q3", "Who?", "The bank.", "d3", None, None, [("The bank pays.", None, "2"), (" ", None, None)]), ("q4", "Why?", " ", None, "No answer.", None, None), ("q5", "How?", "So.", None, None, None, None),
]


def test_pinned_corpus(spark, tmp_path):
    html = "<!DOCTYPE html><html><body><nav><p>menu</p></nav><h2>Part 1</h2><p>" + "word " * 60 + "</p></body></html>"
    (tmp_path / "a.html").write_text(html)
    (tmp_path / "b.xml").write_text("<DIV><HEAD>Sec. 5</HEAD><P>" + "rule " * 50 + "</P></DIV>")
    pins = [{"source": "x", "url": f"http://h/{n}", "path": str(tmp_path / n)} for n in ("a.html", "b.xml", "missing")]
    docs = corpus.pinned(spark, pins)
    chunks = corpus.corpus_chunks(docs)
    got = {r["url"]: r for r in chunks.collect()}
    assert got["http://h/a.html"]["section"] == "Part 1" and got["http://h/b.xml"]["section"] == "Sec. 5" and len(got) == 2
    assert got["http://h/a.html"]["chunk_id"] == hashlib.sha256(b"http://h/a.html").hexdigest()[:10] + "-00000"
    m = {r["url"]: r for r in corpus.manifests(docs, chunks).collect()}
    assert m["http://h/missing"]["error"] and m["http://h/a.html"]["n_chunks"] == 1
    want = hashlib.sha256("\n".join(sorted(hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a.html", "b.xml"))).encode()).hexdigest()
    assert {r["corpus_sha256"] for r in m.values()} == {want}


def test_sections():
    assert files.html_sections("<script><p>x</p></script><p>a<p>b<li>c</li>") == [("p", "a"), ("p", "b"), ("li", "c")]
    assert files.html_sections(None) == []


def test_models(spark):
    c = spark.createDataFrame([(1, "We pay the fee; you sign the form, and they read it."), (2, "Go.")], "id int, text string")
    got = {r["id"]: r for r in models.rewrite_until_simple(c, "id", "text").collect()}
    assert got[1]["accepted"] and got[1]["entailment"] >= 0.75 and got[2]["draft"] == "Go."
    with pytest.raises(KeyError):
        models.model("unknown")

    def call(b: pd.DataFrame) -> pd.DataFrame:
        if (b["id"] == 1).any():
            raise RuntimeError("service is down")
        return b[["id"]]

    got = {r["id"]: r["error"] for r in models.in_batches(c.repartition(2, "id"), ["id"], call, "id int").collect()}
    assert set(got) == {1, 2} and got[1] == "RuntimeError: service is down"
    well = models.in_batches(c, ["id", "text"], lambda b: b.assign(n=b["text"].str.len()), "id int, n int").orderBy("id").collect()
    assert [tuple(r) for r in well] == [(1, 52, None), (2, 3, None)]


def test_gates(spark):
    rows = spark.createDataFrame([(1,), (2,)], "x int")
    assert gates.asserted(rows, F.col("x") > 5, "too large").count() == 2
    with pytest.raises(Exception, match="too large"):
        gates.asserted(rows, F.col("x") > 1, "too large").collect()
    tags = spark.createDataFrame([("llama:8b",), ("llama:70b",), ("qwen:7b",)], "tag string")
    assert [gates.resolve_tag(w, tags).first()[0] for w in ("qwen:7b", "llama", "llama:1b")] == ["qwen:7b", "llama:70b", "llama:70b"]


def test_nli_shapes(spark):
    got = {r["source_id"]: r for r in normalise.contract_pairs(spark.createDataFrame(NLI_ROWS, NLI_SCHEMA)).collect()}
    assert {k: v["label"] for k, v in got.items()} == {"a": "contradiction", "b": "entailment", "c::0": "entailment", "c::1": "contradiction", "d": "entailment", "e": "entailment"}
    assert got["a"]["hypothesis"] == "May it be shared?" and got["a"]["premise"] == "It may not be shared."
    qa = [r.asDict() for r in normalise.qa_examples(spark.createDataFrame(QA_ROWS, QA_SCHEMA)).orderBy("example_id", "text").collect()]
    assert [(r["example_id"], r["page"], r["doc_name"]) for r in qa] == [("q1", None, "d1"), ("q2", 7, "d2"), ("q2", None, None), ("q3", 2, "d3")]
    assert qa[0]["chunk_id"] == "FB-" + hashlib.sha256(b"q1\0" + b"0\0" + b"The fee is ten.").hexdigest()[:16]


def test_put_if_absent(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    incremental.put_if_absent(one, path, "k")
    incremental.put_if_absent(one.unionByName(spark.createDataFrame([("c", 3)], one.schema)), path, "k")
    assert sorted(r["k"] for r in KeyedLog(spark, path, "k").read().collect()) == ["a", "b", "c"]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    src, out = f"file://{tmp_path}/src", f"file://{tmp_path}/out"
    spark.createDataFrame([(1, "a")], "id int, k string").write.parquet(src)
    assert incremental.run_to_table(incremental.stream_table(spark, src), out).count() == 1
    spark.createDataFrame([(2, "b")], "id int, k string").write.mode("append").parquet(src)
    assert sorted(r["id"] for r in incremental.run_to_table(incremental.stream_table(spark, src), out).collect()) == [1, 2]
