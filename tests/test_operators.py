"""Operators on literal rows, and properties that SQL doesn't state."""

from __future__ import annotations

import io
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import benchmark as B
from lexmill.operators import metrics as M
from lexmill.operators import report as P
from lexmill.operators import resample as S
from lexmill.operators import retrieval as R
from lexmill.operators import segment, stress
from lexmill.plans import composite
from lexmill.sources import files, normalise


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def pair(spark, a, b, column):
    return spark.createDataFrame([(a, b)], "a string, b string").select(column.alias("x")).first()["x"]


def test_grades_and_shares_round_halves_as_the_sql(spark):
    import duckdb

    from lexmill.operators import verify
    from lexmill.plans.text import FK_SQL

    words = ["baba"] * 45 + ["ba"] * 35  # 125 syllables in six sentences: 8.0475, but 8.0475 * 1000 is under 8047.5
    text = " ".join(" ".join(words[i::6]).capitalize() + "." for i in range(6))
    assert one(spark, text, X.fk_grade("t")) == duckdb.execute(f"SELECT {FK_SQL} FROM (SELECT ? AS text)", [text]).fetchone()[0] == 8.047
    assert one(spark, None, X.rounded(F.col("t").cast("double"), 3)) is None and one(spark, "-0.0625", X.rounded(F.col("t").cast("double"), 3)) == -0.063
    halves = [(i, k / n) for i, (k, n) in enumerate([(41, 640), (323, 640), (1, 128), (558, 1093)])]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(halves, "i int, v double").select("i", X.rounded("v", 6).alias("x")).collect()}
    assert got == {i: duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for i, v in halves}
    said = [str(i) for i in range(5120)]
    share = verify.token_share(F.array(F.lit("0")), F.split("t", " "))
    assert one(spark, " ".join(said), share) == duckdb.execute("SELECT round(1 / 5120, 9)").fetchone()[0]


def test_text_functions(spark):
    assert one(spark, " co­op -\n eration  be-\nfore\x00now ", X.normalise("t")) == "coop - eration before now"
    assert one(spark, "One. Two! three? 4 is.", X.sentences("t")) == ["One.", "Two! three?", "4 is."]
    assert one(spark, "", X.sentences("t")) == [] and one(spark, None, X.word_count("t")) == 0 and one(spark, "", X.fk_grade("t")) == 0.0
    assert one(spark, "We pay; you sign, and they read.", X.split_long_clauses("t")) == "We pay. You sign. They read."
    assert one(spark, "Fees & Charges -- (New)", X.label_key("t")) == "fees and charges new"
    assert one(spark, "a [x] [Part 2] b", X.section_tag("t")) == "Part 2"
    assert one(spark, "try again in 1m2.5s", X.retry_after("t")) == 62.5 and one(spark, "later", X.retry_after("t")) is None


def test_preservation(spark):
    same = lambda a, b: pair(spark, a, b, X.critical_tokens_preserved("a", "b"))
    assert not same("Pay $10.", "Pay $100.") and not same("You may not leave.", "You may leave.") and same("See 14. Pay 1.5%.", "Pay 1.5.") and not same("Pay.", "Pay 5%.")
    failed = lambda a, b: pair(spark, a, b, X.preservation_failures("a", "b"))
    assert failed("The Bank shall pay 5%.", "The Bank must pay 5%.") == []
    assert failed("You must not pay 5 percent to ACME Bank.", "You may pay 6 percent.") == ["number", "percentage", "negation", "entity", "obligation"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=6), st.lists(st.sampled_from(["a", "b", "c"]), max_size=6), st.lists(st.sampled_from(["a", "b", "e"]), max_size=6))
def test_sari_bounds(spark, s, p, r):
    row = spark.createDataFrame([(" ".join(s), " ".join(p), " ".join(r))], "s string, p string, r string").select(X.sari("s", "p", "r").alias("x"), X.token_f1("p", "r").alias("f")).first()
    assert 0 <= row["x"] <= 100 + 1e-9 and 0 <= row["f"] <= 1
    if p == r and p:
        assert row["f"] == 1 and abs(row["x"] - 100) < 1e-9


def test_segment(spark):
    text = "TERMS\n1. The first clause here.\nit goes on\n2. The second clause here."
    made = [text, "1.1 Definitions\nbody of it\n1.2 Fees\nmore body text", "1. x\n2. y\n3. one two three", "1. one two three\n2. x", "PART A\n1. x\nPART B:\nsome words here\n\n2.\n3.  two\n words", "1. x\n2. y"]
    found = segment.fold_clauses(spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string"), ["doc_id"], "text").orderBy("doc_id", "clause_no").collect()
    by_doc = [[(r["clause"], r["section"]) for r in found if r["doc_id"] == i] for i in range(len(made))]
    assert by_doc[0] == [("1. The first clause here. it goes on", "TERMS"), ("2. The second clause here.", "TERMS")]
    assert [c for c, _ in by_doc[1]] == ["1.1 Definitions body of it", "1.2 Fees more body text"]
    assert [c for c, _ in by_doc[2]] == ["2. y 3. one two three"]
    assert [c for c, _ in by_doc[3]] == ["1. one two three 2. x"]
    assert by_doc[4] == [("1. x some words here", "PART B:"), ("2. 3. two words", "PART B:")]
    assert by_doc[5] == []
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id bigint, text string")
    fold = {(r["doc_id"], r["clause_id"]): r["clause"] for r in segment.fold_clauses(docs, ["doc_id"], "text").collect()}
    wins = {(r["doc_id"], r["clause_id"]): r["clause"] for r in segment.clauses(docs, ["doc_id"], "text").collect()}
    assert fold == wins and len(fold) == 2


def test_chunks(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1000))), (2, "short"), (3, "")], "doc_id bigint, text string")
    got = [(r["chunk_no"], r["token_start"], r["token_end"]) for r in segment.token_chunks(docs, ["doc_id"], "text").orderBy("chunk_no").collect()]
    assert got == [(0, 0, 512), (1, 448, 960), (2, 896, 1000)]


def test_bm25_by_definition(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 20)))) for i in range(12)]
    q = "a b b h z"
    corpus = [t.split() for _, t in docs]
    n, avg = len(corpus), sum(map(len, corpus)) / len(corpus)
    idf = {w: np.log(n - df + 0.5) - np.log(df + 0.5) for w in set(sum(corpus, [])) for df in [sum(w in d for d in corpus)]}
    low = 0.25 * sum(idf.values()) / len(idf)
    want = {i: sum((idf[w] if idf[w] >= 0 else low) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in q.split() if w in idf) for (i, _), d in zip(docs, corpus, strict=True)}
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, q)], "q_id bigint, text string")
    got = {r["doc_id"]: r for r in R.bm25(queries, d, fill_zero=12).collect()}
    assert {i: round(x["raw"], 6) for i, x in got.items()} == {i: round(float(v), 6) for i, v in want.items()}
    best = max(x["raw"] for x in got.values())
    assert all(abs(x["score"] - (x["raw"] / best if best > 0 else 0)) < 1e-9 for x in got.values()) and sorted(x["rank"] for x in got.values()) == list(range(1, 13))


def test_bm25_sends_the_small_side_or_joins(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "the the")], "doc_id bigint, text string"))
    few = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("q_id"), "text").unionByName(spark.createDataFrame([(-1, None), (-2, "zzzz"), (-3, "the the of")], "q_id bigint, text string"))
    swap = lambda df, a, b: df.withColumnRenamed(a, b)
    for queries, corpus in ((few, docs), (swap(docs, "doc_id", "q_id"), swap(few, "q_id", "doc_id"))):
        for k in (3, None):
            monkeypatch.setattr(R, "POSTINGS", 1_000_000)
            sent = sorted((r["q_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in R.bm25(queries, corpus, k).collect())
            monkeypatch.setattr(R, "POSTINGS", 0)
            assert sent and sent == sorted((r["q_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in R.bm25(queries, corpus, k).collect())


def test_holding(spark):
    docs = spark.createDataFrame([(1, "x y one two three four five six seven z"), (2, "one two three four five six"), (3, "hi there")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "one two three four five six seven"), (2, "hi"), (3, "one two three four five six eight nine")], "q_id bigint, text string")
    assert sorted(tuple(r) for r in R.holding(asked, docs).collect()) == [(1, 1), (2, 3)]


def test_metrics_on_literals(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "label int, score double")
    m = M.binary_metrics(M.binary_counts(rows, [], F.col("label"), F.col("score") >= 0.75), []).first()
    assert m["precision"] == m["recall"] == 1 and m["predicted_unsupported_rate"] == 0.5
    rows = spark.createDataFrame([("Safe", "Needs Review"), ("Hidden Fee", "Hidden Fee")], "t string, p string")
    m = M.multiclass_metrics(rows, ["Hidden Fee", "Safe"], "t", "p").first()
    assert (m["accuracy"], m["n_invalid"], m["invalid_rate"]) == (0.5, 1, 0.5)
    top = spark.createDataFrame([(1, 10, 1), (1, 12, 2), (1, 11, 3), (2, 9, 1)], "q_id bigint, doc_id bigint, rank bigint")
    gold = spark.createDataFrame([(1, 11), (1, 12), (2, 5)], "q_id bigint, doc_id bigint")
    m = M.retrieval_multi(top, gold, 3).first()
    assert (m["recall"], m["mrr"], m["n_examples"]) == (0.5, 0.25, 2)
    pairs = lambda b, c: M.mcnemar(spark.createDataFrame([(True, False)] * b + [(False, True)] * c + [(True, True)], "a boolean, b boolean"), [], F.col("a"), F.col("b")).first()["p_value"]
    assert pairs(20, 0) < 0.001 and pairs(10, 10) > 0.5 and pairs(0, 0) == 1.0


def test_kappas(spark):
    r = spark.createDataFrame([(s, k, c) for s, cs in enumerate([(0, 0), (1, 1), (0, 0), (1, 1)]) for k, c in enumerate(cs)] + [(9, 0, 1)], "s int, k int, c int")
    assert M.fleiss_kappa(r, "s", "k", "c").first()["kappa"] == 1.0
    assert M.fleiss_kappa(r.where("c = 0"), "s", "k", "c").first()["kappa"] is None
    p = spark.createDataFrame([(1, 1), (2, 3), (3, 3), (5, 4)], "a int, b int")
    assert M.ordinal_agreement(p, "a", "b").first()["mae"] == 0.5


def test_draws_are_even(spark):
    for n in (40, 399, 5000):
        d = S.draws(spark, n, 100, 42)
        means = np.array([r["m"] for r in d.groupBy("sample").agg(F.avg("idx").alias("m")).collect()])
        assert abs(means.mean() / ((n - 1) / 2) - 1) < 0.03
        assert 0.7 < means.std() / (n / np.sqrt(12 * n)) < 1.35


def test_bootstrap(spark):
    rows = spark.createDataFrame([(i, i % 2, (i * 37 % 100) / 100, f"c{i // 2}") for i in range(40)], "i bigint, label int, score double, g string")
    m = S.mean_ci(rows, "score", ["i"], 200, 1).first()
    assert m["mean_lower"] < m["mean"] < m["mean_upper"]
    assert S.precision_recall_ci_clustered(rows, "label", "score", 0.5, "g", 50, 1).first()["n_groups"] == 20
    with pytest.raises(Exception, match="no group"):
        S.precision_recall_ci_clustered(rows.withColumn("g", F.lit(" ")), "label", "score", 0.5, "g", 5, 1).collect()
    e = S.exact_rng_ci(rows.withColumn("k", F.lit("x")), ["k"], "score", 200, 42).first()
    x = np.array([(i * 37 % 100) / 100 for i in range(40)])
    rng = np.random.default_rng(42)
    means = [x[rng.integers(0, 40, 40)].mean() for _ in range(200)]
    assert abs(e["lower"] - np.quantile(means, 0.025)) < 1e-12
    p = S.poisson_mean(rows, "score", "i", 100, 3).first()
    assert p["mean_lower"] < x.mean() < p["mean_upper"]


def test_decisions_and_routing(spark):
    rows = spark.createDataFrame([(0.9, None), (0.2, 0.9), (0.9, 0.2)], "s double, r double")
    dual = [r["d"] for r in rows.select(P.primary(F.col("s"), F.col("r"), "dual").alias("d")).collect()]
    assert [d["supported"] for d in dual] == [False, False, False]
    assert [d["reason"] for d in dual] == ["no regulatory evidence was retrieved", "source clause does not entail sentence", "retrieved evidence does not entail sentence"]
    schema = "clause_id int, risk_label string, risk_score int, simplification_status string, semantic_target_met boolean, n_evidence int, sentences array<struct<source:double,regulatory:double,chunk_id:string>>"
    c = spark.createDataFrame([(1, "Needs Review", 4, "needs_review", False, 1, [(0.1, 0.9, None)]), (2, "Safe", 1, "accepted", None, 0, [])], schema)
    got = {r["clause_id"]: r["reasons"] for r in P.routed(c, "strict_policy").collect()}
    assert got == {1: P.REASONS, 2: []} and {r["clause_id"]: r["reasons"] for r in P.routed(c).collect()} == {1: P.REASONS[:2], 2: []}


def test_benchmark_pieces(spark):
    rows = spark.createDataFrame([(i, "a" if i < 9 else "b") for i in range(12)], "i bigint, lab string")
    assert {r["lab"]: r["count"] for r in B.oversample(rows, "lab", ["i"]).groupBy("lab").count().collect()} == {"a": 9, "b": 9}
    have = B.balanced_quotas(B.supply(rows, ["a", "b", "c"], "lab"), 10, 3)
    assert [r["required"] for r in have.orderBy("ordinal").collect()] == [4, 3, 3]
    assert [r["status"] for r in B.achievable(have, 3, 2).orderBy("ordinal").collect()] == ["limited", "infeasible", "infeasible"]
    with pytest.raises(ValueError):
        B.balanced_quotas(have, 2, 3)


def test_stress_conditions_complete(spark):
    rows = spark.createDataFrame([(i, n) for i in (1, 2) for n in stress.CONDITIONS], "source_id int, condition string")
    assert stress.incomplete_conditions(rows, "source_id").count() == 0
    assert [r[0] for r in stress.incomplete_conditions(rows.where("not (source_id = 2 and condition = 'unseen_jurisdiction')"), "source_id").collect()] == ["unseen_jurisdiction"]


def test_replies_and_metrics():
    assert files.items_of(files.first_json('x {"items": {"items": [{"id": 1}]}} y'), {"id": "k"}) == [{"k": 1}]
    assert files.first_json("{broken [1, 2]") == [1, 2] and files.first_json("none") is None
    assert files.flatten({"a": {"b": 1}, "c": [1, 2], "d": [{"x": 1}], "e": None}) == [("a.b", "1"), ("c", "[1, 2]"), ("e", "null")]


def test_plain_reply(spark):
    got = spark.createDataFrame([("```\nShort text.\n```", '{"source_id": "s1"} and "source_id": "s1"'), ("text", '"source_id": "a" "source_id": "b"'), ('{"a": 1}', '"source_id": "a"')], "r string, p string")
    out = [r[0] for r in got.select(files.plain_reply("r", "p")).collect()]
    assert out[0].asDict() == {"source_id": "s1", "text": "Short text."} and out[1:] == [None, None]


def test_contract_files(spark, tmp_path):
    doc = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", doc)
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "b.txt").write_bytes(b"caf\xc3\xa9 \xff")
    got = {(r["method"], r["block_number"]): r["text"] for r in files.read_contracts(spark, f"file://{tmp_path}/*").collect()}
    assert got == {("docx", 0): "One", ("docx", 1): "a | b", ("txt", 0): "café �"}
    found = spark.read.format("binaryFile").load(f"file://{tmp_path}/*")
    assert [r["problem"] for r in files.accepted_uploads(found, 10**6).collect()] == [None, None]
    assert files.artefact_hashes(spark, f"file://{tmp_path}").count() == 2


def test_form_and_masks(spark):
    r = spark.createDataFrame([("Reviewer 2", "yes", None)], "who string, `[r1] Is it supported?` string, `[r2] Is it supported?` string")
    assert [tuple(x) for x in files.form_answers(r, "who").collect()] == [("r1", "reviewer_2_is_it_supported", "yes")]
    m = spark.sql("select map('api_key', 'x', 'name', 'y') as m").select(normalise.masked(F.col("m")).alias("m")).first()["m"]
    assert m == {"api_key": "***", "name": "y"}


def test_variants_resume(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "variant string, v int")
    path = f"file://{tmp_path}/v"
    assert files.write_missing_variants(rows, path, "variant") == ["a", "b"]
    assert files.write_missing_variants(rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema)), path, "variant") == ["c"]
    assert spark.read.parquet(path).count() == 3


def test_targets(spark):
    r = composite.against_targets(spark.createDataFrame([("s", "f1", 0.8), ("s", "ece", 0.2), ("s", "mrr", 0.1), ("s", "recall", None)], "section string, metric string, value double"))
    assert {x["metric"]: x["status"] for x in r.collect()} == {"f1": "pass", "ece": "fail", "mrr": "reported", "recall": "missing"}


def test_fuzzy_clause_match_takes_all_documents(spark, sf):
    from lexmill.plans.ingestion import fuzzy_clause_match

    got = {r["doc_id"] for r in fuzzy_clause_match(spark, sf).select("doc_id").collect()}
    assert got == {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()} | {None}


def test_noise_is_quick_and_changes_letters_only_where_scanning_does():
    import time

    text = "All rules of the club in modern clauses. " * 5000
    began = time.perf_counter()
    noisy = stress.with_noise(text)
    assert time.perf_counter() - began < 5 and noisy != text and noisy == stress.with_noise(text)
    assert len(text) - 2 * len(text) // 100 <= len(noisy) <= len(text)
    assert stress.with_noise(None) is None and stress.with_noise("") == "" and stress.with_noise("xyz") == "xyz" and stress.with_noise("l") in ("1", "l")


def test_syllables_of_a_text_are_those_of_its_words(spark):
    import random
    import re

    from lexmill.functions import text as X

    def plain(text):
        total = 0
        for w in re.findall("[A-Za-z]+", text):
            n = len(re.findall("[aeiouy]+", w.lower()))
            total += max(1, n - (w.lower().endswith("e") and n > 1))
        return total

    rng = random.Random(1)
    texts = ["".join(rng.choice("aeiouybcdtxEAZ é1.") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["", "the", "be", "rhythm", "Tree agree use", "x" * 70_000 + "e", "banane" * 20_000, "eee e ée eé", "queue eye bye-bye"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", X.syllables("t").alias("n")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_pieces_keep_digits_at_their_ends(spark):
    """Digits equal to a piece's place were taken off its ends."""
    assert one(spark, "So. 19.37.233.111", X.sentences("t")) == ["So.", "19.37.233.111"]
    assert one(spark, "10 of 20.", X.sentences("t")) == ["10 of 20."]
    assert one(spark, "We pay 0; 12 of 31.", X.split_long_clauses("t")) == "We pay 0. 12 of 31."


def test_negations_end_at_letters_that_are_not_ascii(spark):
    """Words are ASCII, as in the SQL; Java's own edges took the letter for a part of the word."""
    assert not pair(spark, "Casa.", "No\u00f1asci la.", X.critical_tokens_preserved("a", "b"))
    assert pair(spark, "Casa.", "Nona_no nota.", X.critical_tokens_preserved("a", "b"))


def test_facts_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from lexmill.plans import text as plans

    pieces = ["No\u00f1asci", "no", "pay $5.50.7", "1.2.3", "a.5", "$$5", "\u00e9Bank", "Acme  Bank", "Foo-\n Bank", "UN\u00e9", "UN", "5 %\u00e9", "5 percent", "5%", "May 3, 2024", "3 May 2024\u00e9", "must\u00e9", "cannot", "can't", "unle\u017f", "\u00f1shall not", "7,5"]
    rows = [(i * len(pieces) + j, turn, "user", text) for i, a in enumerate(pieces) for j, b in enumerate(pieces) for turn, text in ((0, a), (1, f"x {b} y"), (2, "z"))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for name in ("preservation_checks", "critical_tokens_preserved"):
        got = sorted(map(tuple, getattr(plans, name)(spark, f"{tmp_path}").collect()))
        assert got == sorted(con.execute(plans.query.__globals__["_oracles"][name]).fetchall()), name


def test_normalising_and_headings_by_definition(spark):
    """Against the plain patterns; prose must not be normalised or counted to know that it is no heading."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", "-", "\n", " ", "\t", "­", "\x00", " ", ":", "7", "é", "\x0b", "\r"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "TERMS AND CONDITIONS", "Scope:", "Scope:­", "SCO­PE OF", " FEES DUE ", "A " * 13 + "B", "one two:", "DUE\x00DATES"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("t"), "­", ""), "\\x00", " "), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")
    whole = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", "")
    head = (X.word_count(whole) <= 12) & (whole.rlike("^[A-Z][A-Z0-9 /&(),.'-]{3,100}$") | whole.endswith(":"))
    got = F.when(X.maybe_heading(F.col("t")), X.is_heading(X.normalise("t"))).otherwise(False)
    rows = df.select("i", X.normalise("t").alias("a"), whole.alias("b"), got.alias("c"), F.coalesce(head, F.lit(False)).alias("d"), F.trim("t", F.lit(" \t\n\x0b\f\r")).alias("e"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("f")).collect()
    assert [r for r in rows if (r["a"], r["c"], r["e"]) != (r["b"], r["d"], r["f"])] == []
    assert str(X.is_heading(F.col("t"))).index("THEN") < str(X.is_heading(F.col("t"))).index("size")
