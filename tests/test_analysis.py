"""Whole contracts analysed: clauses meet their evidence in their rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import retrieval, verify
from lexmill.plans import composite


def made(spark, seed=1):
    rng = random.Random(seed)
    words = [*"alpha beta gamma delta no not 12 7.5% shall pay the fee within days of notice İstanbul straße K2".split(), "x" * 30]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    sentence = lambda: line(rng.randint(1, 14)).capitalize() + rng.choice([".", "!", "; " + line(4) + ".", ", and " + line(3) + "."])
    docs = [(i, "\n".join([*(f"{k + 1}. " + " ".join(sentence() for _ in range(rng.randint(1, 9))) for k in range(rng.randint(0, 6))), rng.choice(["", "END:", "??? !!!"])])) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "­  \n "), (103, "... !!! ???"), (104, "Two words"), (105, "日本 語 です . は")]
    chunks = [(k, line(rng.randint(1, 20))) for k in range(12)] + [(50, None), (51, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(chunks, "doc_id long, text string")


def rows(df):
    return sorted((r["clause_id"], r["n_evidence"], r["fk_grade"], r["simplified"], sorted((round(s["source"], 9), s["regulatory"], s["chunk_id"] or "") if s["regulatory"] is not None else (s["source"], -1.0, "") for s in r["sentences"])) for r in df.collect())


@pytest.mark.parametrize("suppress", [False, True])
def test_clauses_judged_in_their_rows_equal_those_judged_by_joins(spark, monkeypatch, suppress):
    docs, chunks = made(spark)
    with monkeypatch.context() as m:
        m.setattr(verify, "verify", lambda *_: pytest.fail("sentences left their rows"))
        got = rows(composite.analyse(docs, chunks, suppress=suppress))
    monkeypatch.setattr(retrieval, "POSTINGS", 0)
    assert got == rows(composite.analyse(docs, chunks, suppress=suppress)) and len(got) > 60
    assert any(r[1] == 3 for r in got) and any(s[2] for r in got for s in r[4])


def test_texts_are_moved_once(spark, monkeypatch):
    """The plan of all documents has the one exchange that deals them out, and each sentence isn't held against its clause's text again."""
    docs, chunks = made(spark)
    plan = composite.analyse(docs, chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("ArrowEvalPython") == 1 and "posexplode(said" not in plan
    cut = []
    monkeypatch.setattr(verify.A, "cut_tokens", lambda texts, f=verify.A.cut_tokens: cut.append(len(texts)) or f(texts))
    small = (pa.array(["fee"]), *map(np.array, ([0, 1], [0], [1.0])), pa.array([7]))
    said = pa.array([["The fee.", "No."] * 50, None, []], pa.list_(pa.string()))
    got = verify._counted(pa.array(["The fee. No.", "a", ""]), said, small, np.array([0]), 3).to_pylist()
    assert cut == [3, 100]
    assert [x["n_evidence"] for x in got] == [1, 0, 0] and got[1]["sentences"] == got[2]["sentences"] == []
    assert got[0]["sentences"][:2] == [{"tokens": 2, "own": 2, "best": 1, "chunk_id": "7"}, {"tokens": 1, "own": 1, "best": 0, "chunk_id": "7"}]


def test_texts_of_odd_white_space(spark):
    odd = ["a  b", " a\tb ", "a b", "a    b\x00c", "­", " ­\x00 ", "", "co-\n op", "x\x1cy", "one", " one two ", "one two three", "    ", "n\u0085m"]
    r = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, t string")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.replace("t", F.lit("­"), F.lit("")), F.lit("\x00"), F.lit(" ")), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", ""), r"(?U)\s+", " "))
    for x in r.select("t", plain.alias("want"), X.normalise("t").alias("got"), X.is_blank("t").alias("blank"), X.word_count("t").alias("n"), *(X.has_words("t", k).alias(f"w{k}") for k in (0, 1, 2, 3))).collect():
        assert x["got"] == x["want"] and x["blank"] == (x["want"] == ""), x
        assert [x[f"w{k}"] for k in (0, 1, 2, 3)] == [x["n"] >= k for k in (0, 1, 2, 3)], x


def test_negations_and_new_numbers(spark):
    edge = X.EDGE
    said = ["no", "No.", "know", "not_", "é not é", "without", "unles", "UNLEſS", "_no", "no9", "(never)", "nono", "", "Without 5", "xéno", "noé"]
    r = spark.createDataFrame([(x,) for x in said], "t string")
    for x in r.select("t", F.col("t").rlike(X.NEGATION).alias("got"), F.col("t").rlike(rf"(?iu){edge}(no|not|never|without|unless){edge}").alias("want")).collect():
        assert x["got"] == x["want"], x
    pairs = spark.createDataFrame([("a 5", "b"), ("a 5", "a 5%"), ("a", "a 5"), ("a 5", "a ٥"), (None, "a"), ("a", None)], "a string, b string")
    assert [x[0] for x in pairs.select(X.critical_tokens_preserved("a", "b")).collect()] == [True, True, False, True, None, None]


def test_clause_results_write_no_table_of_texts(spark, sf, monkeypatch):
    """Clauses aren't stored on the way: what leads to the result is one plan, in which texts move once."""
    monkeypatch.setattr(composite, "stored", lambda *_: pytest.fail("clauses were stored"))
    df = composite.clause_results(spark, sf)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert df.where("mean_source_faithfulness is null").count() < df.count()
