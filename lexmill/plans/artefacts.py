"""Queries of manifests, sinks, acceptance checks and of what an evaluation joins to its records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import _oracles, query, table
from ..functions import text as X
from ..operators import gates as G
from ..operators import metrics as M
from ..operators import retrieval as R
from ..session import scratch, ship
from ..sources import corpus, files, manifests, normalise, sinks
from ..streaming.keyed_log import KeyedLog
from . import retrieval
from .ingestion import _WORDS
from .text import documents


@query(rf"""WITH r AS (SELECT *, 'd' || doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN source END AS file_name FROM documents),
 a AS (SELECT coalesce(file_name, id) AS source_id, coalesce(file_name, id) AS document_id, trim(text) AS text, lang AS question FROM r WHERE doc_id % 2 = 0 AND trim(text) <> ''
  UNION ALL SELECT id || '::' || (pos - 1), coalesce(file_name, source), trim(t), 'Q ' || lang FROM r, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(t, pos) WHERE doc_id % 2 = 1)
SELECT source_id, document_id, text, question, 'contracts' AS dataset, 'train' AS split FROM a WHERE {_WORDS.format('text')} >= 5""")
def contract_clause_scan(spark, sf_dir):
    i, direct = F.col("doc_id"), F.col("doc_id") % 2 == 0
    rows = documents(spark, sf_dir).select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.when(i % 4 == 0, F.col("source")).alias("file_name"), F.col("source").alias("title"), F.when(direct, F.col("text")).alias("clause"),
        F.col("lang").alias("label"), F.concat(F.lit("Q "), "lang").alias("question"), F.when(~direct, F.struct(F.split("text", "\n").alias("text"))).alias("answers"),
    )
    return manifests.contract_clauses(rows, "contracts", "train")


@query("""WITH l AS (SELECT doc_id, pos, trim(t) AS t FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(t, pos))
SELECT 'doc' || doc_id AS path, count(*) AS n, string_agg(t, chr(10) ORDER BY pos) AS clauses FROM l WHERE t <> '' GROUP BY doc_id""")
def parser_gold_scan(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.concat(F.lit("doc"), "doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "clause"))
    g = manifests.gold_clauses(rows, "path", "clause", "at")
    return g.select("path", F.size("gold_clauses").cast("bigint").alias("n"), F.array_join("gold_clauses", "\n").alias("clauses"))


_LABELS = ["Hidden Fee", "Penalty Clause", "Safe"]


@query(rf"""WITH r AS (SELECT doc_id, 'src' || doc_id % 90 AS source_id, CASE doc_id % 4 WHEN 0 THEN 'hidden-fee' WHEN 1 THEN 'Penalty  Clause' WHEN 2 THEN 'SAFE' ELSE 'other' END AS raw, text, doc_id % 3 > 0 AS human, doc_id % 7 > 0 AS kept_out FROM documents),
 t AS (SELECT *, 'external_gold' AS tier, 0 AS o FROM r WHERE doc_id % 2 = 0 AND human AND kept_out UNION ALL SELECT *, 'silver', 1 FROM r WHERE doc_id % 2 = 1 AND kept_out),
 k AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'Hidden Fee' WHEN 1 THEN 'Penalty Clause' WHEN 2 THEN 'Safe' END AS risk_label FROM t WHERE doc_id % 4 < 3 AND {_WORDS.format('text')} >= 8)
SELECT source_id, 'doc' || doc_id AS document_id, risk_label, tier FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY o, doc_id) AS rn FROM k) WHERE rn = 1""")
def gold_candidate_scan(spark, sf_dir):
    i = F.col("doc_id")
    raw = F.when(i % 4 == 0, "hidden-fee").when(i % 4 == 1, "Penalty  Clause").when(i % 4 == 2, "SAFE").otherwise("other")
    r = documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("src"), i % 90).alias("source_id"), F.concat(F.lit("doc"), i).alias("document_id"), raw.alias("risk_label"), "text",
        (i % 3 > 0).alias("human_reviewed"), (i % 7 > 0).alias("excluded_from_training"),
    )
    tiers = [("external_gold", r.where(i % 2 == 0), True), ("silver", r.where(i % 2 == 1), False)]
    return manifests.candidates(tiers, _LABELS, "doc_id").select("source_id", "document_id", "risk_label", "tier")


@query("""WITH d AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'unspecified' ELSE lang END AS document_type, source AS jurisdiction, n_chars, CASE WHEN doc_id % 3 > 0 THEN length(text) END AS n_text FROM documents WHERE doc_id % 11 > 0),
 l AS (SELECT 'document_type' AS dimension, document_type AS value, n_chars, n_text FROM d UNION ALL SELECT 'jurisdiction', jurisdiction, n_chars, n_text FROM d UNION ALL SELECT 'scan_quality', 'unspecified', n_chars, n_text FROM d)
SELECT dimension, value, greatest(count(n_chars), count(n_text)) AS documents, round(avg(n_chars), 4) AS mean_n_chars, round(avg(n_text), 4) AS mean_n_text FROM l GROUP BY ALL""")
def document_manifest_stress(spark, sf_dir):
    i = F.col("doc_id")
    meta = F.create_map(F.lit("document_type"), F.when(i % 5 > 0, F.col("lang")).otherwise(""), F.lit("jurisdiction"), F.col("source"))
    d = documents(spark, sf_dir).select(F.when(i % 11 > 0, "ok").otherwise("error").alias("status"), meta.alias("metadata"), "n_chars", F.when(i % 3 > 0, F.length("text")).alias("n_text"))
    out = manifests.by_dimension(d, ["n_chars", "n_text"], ["document_type", "jurisdiction", "scan_quality"])
    return out.select("dimension", "value", "documents", F.round("mean_n_chars", 4).alias("mean_n_chars"), F.round("mean_n_text", 4).alias("mean_n_text"))


@query("SELECT page_id, url FROM pages")
def json_lines_export(spark, sf_dir):
    """Written to the shared folder as JSON lines and read back."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    path = scratch(spark, "json-lines")
    sinks.write_json_lines(p, path)
    return spark.read.schema(p.schema).json(path)


@query("""SELECT CASE WHEN name = '' THEN 'document' ELSE name END AS report, '{"event_type":"' || event_type || '","n":' || n || '}' AS line
 FROM (SELECT event_type, count(*) AS n, substr(event_type || '_' || repeat('x', 100), 1, 80) AS name FROM events GROUP BY event_type)""")
def document_reports(spark, sf_dir):
    """A report for each event type, written under a long name and read back."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    path = scratch(spark, "reports")
    sinks.write_reports(e, path, F.concat(F.lit("/in/"), "event_type", F.lit("_" + "x" * 100 + ".pdf")))
    return spark.read.schema("value string, report string").text(path).select("report", F.col("value").alias("line"))


@query(r"""WITH r AS (SELECT source || ' | ' || lang AS section, count(*) AS n FROM documents GROUP BY source, lang)
SELECT '# Results' AS line UNION ALL SELECT '' UNION ALL SELECT '| section | n |' UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || replace(section, '|', '\|') || ' | ' || n || ' |' FROM r""")
def results_markdown(spark, sf_dir):
    r = documents(spark, sf_dir).groupBy(F.concat("source", F.lit(" | "), "lang").alias("section")).agg(F.count("*").alias("n"))
    return sinks.markdown_lines(r, ["section"], "Results")


@query("""SELECT 'accepted' AS rule, true AS passed UNION ALL SELECT 'seed', false UNION ALL SELECT 'taxonomy', true
 UNION ALL SELECT 'labels', (SELECT list_sort(list(DISTINCT lang)) FROM documents) = ['de', 'en', 'es', 'fr']""")
def plan_acceptance(spark, sf_dir):
    plan = documents(spark, sf_dir).agg(F.collect_set("lang").alias("labels")).select(F.lit(True).alias("accepted"), F.lit(41).alias("seed"), F.sha2(F.lit("taxonomy"), 256).alias("taxonomy_sha256"), "labels")
    return G.plan_acceptance(plan, 42, F.sha2(F.lit("taxonomy"), 256), ["en", "de", "fr", "es"])


@query("""WITH f AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (WHERE text IS NULL OR text = '') AS blank, (SELECT count(*) FROM labels) AS labelled FROM documents),
 c AS (SELECT 'documents present' AS name, 'error' AS severity, n > 0 AS passed FROM f UNION ALL SELECT 'ids unique', 'error', n = ids FROM f UNION ALL SELECT 'half labelled', 'warning', labelled * 2 >= n FROM f UNION ALL SELECT 'texts filled', 'error', blank = 0 FROM f)
SELECT *, (SELECT bool_and(passed) FROM c WHERE severity = 'error') AS ready FROM c""")
def preflight_checks(spark, sf_dir):
    d = documents(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.coalesce(F.col("text") == "", F.lit(True))).alias("blank"))
    facts = d.crossJoin(table(spark, sf_dir, "labels").agg(F.count("*").alias("labelled")))  # one row each
    n = F.col("n")
    return G.preflight(facts, {
        "documents present": ("error", n > 0), "ids unique": ("error", n == F.col("ids")), "half labelled": ("warning", F.col("labelled") * 2 >= n), "texts filled": ("error", F.col("blank") == 0),
    })


@query("""SELECT conv_id AS source_id, count(*) AS n, count(*) FILTER (WHERE turn % 2 = 0) AS assessed, string_agg(turn || ':' || length(text) || ':' || CASE WHEN turn % 2 = 0 THEN role ELSE '-' END, ' ' ORDER BY turn) AS variants FROM conversations GROUP BY conv_id""")
def judged_variants(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("variant_id"), F.concat("conv_id", F.lit("/"), "turn").alias("judge_id"))
    v = t.select(F.col("conv_id").alias("source_id"), "turn", "variant_id", "judge_id")
    g = G.judged_variants(v, t.select("variant_id", F.length("text").alias("n")), t.where("turn % 2 = 0").select("judge_id", F.col("role").alias("verdict")), "source_id", "variant_id", "judge_id")
    told = F.transform("variants", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["metrics"]["n"].cast("string"), F.coalesce(x["assessment"]["verdict"], F.lit("-"))))
    return g.select("source_id", F.size("variants").cast("bigint").alias("n"), F.size(F.filter("variants", lambda x: x["assessment"].isNotNull())).cast("bigint").alias("assessed"), F.array_join(told, " ").alias("variants"))


_TOK = retrieval._TOK


@query(f"""WITH f AS (SELECT conv_id, text AS clause FROM conversations WHERE turn = 0)
SELECT conv_id, turn, round(len(list_intersect({_TOK.format('text')}, {_TOK.format('clause')})) / nullif(len(list_distinct({_TOK.format('text')})), 0), 6) AS score FROM conversations JOIN f USING (conv_id) WHERE turn > 0""")
def fixed_hypothesis_scores(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    clause = t.where("turn = 0").select("conv_id", F.col("text").alias("clause"))
    h = F.array_distinct(X.tokens("text"))
    overlap = F.try_divide(F.size(F.array_intersect(h, X.tokens("clause"))), F.size(h))
    return G.fixed_hypothesis(t.where("turn > 0"), clause, "conv_id", overlap).select("conv_id", "turn", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN doc_id % 5 END AS picked, doc_id % 5 < 3 AND doc_id % 2 = 0 AS supported FROM documents""")
def judge_pick_gate(spark, sf_dir):
    i = F.col("doc_id")
    r = documents(spark, sf_dir).select("doc_id", (i % 5).alias("picked"), F.array(*(F.lit(x).cast("bigint") for x in range(3))).alias("pool"), (i % 2 == 0).alias("supported"))
    return G.picked_evidence(r, "picked", "pool", "supported").select("doc_id", "picked", "supported")


@query("SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY lang")
def ordered_sources(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("lang").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query(f"SELECT conv_id, turn, len(list_filter({_TOK.format('role')}, lambda t: NOT list_contains({_TOK.format('text')}, t))) = 0 AS named, len(list_filter({_TOK.format('text')}, lambda t: NOT list_contains(['the', 'a', 'of'], t))) = 0 AS bare FROM conversations")
def subset_test(spark, sf_dir):
    t = X.tokens("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.subset_of(X.tokens("role"), t).alias("named"), X.subset_of(t, F.array(*map(F.lit, ("the", "a", "of")))).alias("bare"))


@query(r"SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:220], ' ') AS text FROM documents")
def supplement_texts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.first_words("text", 220).alias("text"))


@query("SELECT event_id, array_to_string(list_sort(list_distinct(list_filter([event_id % 9, user_id % 7, 5], lambda x: x > 0))), ',') AS grid, event_type || ',' || event_id AS items FROM events")
def settings_lists(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.concat_ws(", ", (F.col("event_id") % 9).cast("string"), F.lit("x"), (F.col("user_id") % 7).cast("string"), F.lit("-3"), F.lit("5"), F.lit(""))
    return e.select("event_id", F.array_join(X.int_grid(raw), ",").alias("grid"), F.array_join(X.comma_list(F.concat(F.lit(" ,"), "event_type", F.lit(" ,, "), "event_id")), ",").alias("items"))


@query("SELECT doc_id, (doc_id % 5 + (doc_id % 2 = 0)::INT)::INT AS n, CASE WHEN doc_id % 2 = 0 THEN lang END AS revision FROM documents")
def settings_maps(spark, sf_dir):
    """Maps of different sizes in JSON; blank keys and null values go."""
    revision = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"'), "lang", F.lit('"'))).otherwise("null")
    own = F.transform(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= F.col("doc_id") % 5), lambda i: F.concat(F.lit('"k'), i, F.lit('": "'), F.col("doc_id") + i, F.lit('"')))
    m = X.string_map(F.concat(F.lit("{"), F.array_join(F.concat(own, F.array(F.lit('"": "blank"'), F.concat(F.lit('"revision": '), revision))), ", "), F.lit("}")))
    return documents(spark, sf_dir).select("doc_id", F.size(m).alias("n"), F.try_element_at(m, F.lit("revision")).alias("revision"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at, round(value::DOUBLE, 0) AS ms FROM events")
def iso_durations(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.round("value", 0))
    ts = F.to_utc_timestamp(F.col("ts").cast("timestamp_ntz").cast("timestamp"), "UTC")
    return e.select("event_id", X.iso_utc(ts).alias("at"), X.elapsed_ms(ts, F.timestamp_micros(F.unix_micros(ts) + (F.col("value") * 1000).cast("bigint"))).alias("ms"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN quality WHEN 1 THEN toxic WHEN 2 THEN 0.5 END::DOUBLE AS found FROM labels")
def metric_find(spark, sf_dir):
    ship(spark)
    q, t = F.col("quality"), F.col("toxic")
    shapes = [("own before inner", '{{"x": {{"f1": 9}}, "f1": {}}}', q), ("inner, list", '{{"f1": "n/a", "rows": [1, {{"macro_f1": {}}}]}}', t), ("first branch", '{{"a": {{"b": {{"f1": 0.5}}}}, "c": {{"f1": {}}}}}', q)]
    payload = F.lit("{broken")
    for n, (_, shape, value) in enumerate(shapes):
        before, after = (x.replace("{{", "{").replace("}}", "}") for x in shape.split("{}"))
        payload = F.when(F.col("doc_id") % 4 == n, F.concat(F.lit(before), value, F.lit(after))).otherwise(payload)
    return table(spark, sf_dir, "labels").select("doc_id", files.first_metric(payload, ["f1", "macro_f1"]).alias("found"))


_QA = f"""WITH {retrieval.bm25_sql()}, {retrieval.GOLD}, {retrieval.DENSE},
 rs AS (SELECT r.q_id, r.doc_id, r.rank, round(len(list_intersect({_TOK.format('b.text')}, {_TOK.format('d.text')})) / len(list_distinct({_TOK.format('b.text')})), 9) AS s FROM dr r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = r.q_id WHERE r.rank <= 20),
 nr AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, rank) AS rank FROM rs)"""


def _stage(top: str, k: int) -> str:
    return f"SELECT '{top}' AS stage, * FROM (WITH {retrieval._MULTI.format(top=top, k=k)} SELECT {retrieval._AVG} FROM pq)"


@query(f"{_QA} {_stage('dr', 20).replace(chr(39) + 'dr' + chr(39), chr(39) + 'dense_top_k' + chr(39))} UNION ALL {_stage('nr', 5).replace(chr(39) + 'nr' + chr(39), chr(39) + 'reranked_top_j' + chr(39))}")
def qa_retrieval_evaluation(spark, sf_dir):
    """Questions against the distinct evidence: dense top k, reranked top j, metrics of both."""
    asked, texts = retrieval.passages(spark, sf_dir), retrieval.texts(spark, sf_dir)
    gold = retrieval.gold(spark, sf_dir)
    dense = R.hashed_dense(asked, texts, 20)
    cand = retrieval.with_overlap(dense.select("q_id", "doc_id", "rank"), asked, texts)
    best = R.rerank(cand, F.col("s"), 5).select("q_id", "doc_id", F.col("new_rank").alias("rank"))
    measured = [M.retrieval_multi(t, gold, k).select(F.lit(n).alias("stage"), "*") for n, t, k in (("dense_top_k", dense, 20), ("reranked_top_j", best, 5))]
    return measured[0].unionByName(measured[1])


@query(f"""WITH {retrieval.bm25_sql()}, s AS (SELECT r.q_id, r.doc_id, r.rank, round(len(list_intersect({_TOK.format('b.text')}, {_TOK.format('d.text')})) / len(list_distinct({_TOK.format('b.text')})), 9) AS s FROM rk r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = r.q_id WHERE r.rank <= 5),
 p AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, rank) AS n FROM s)
SELECT q_id, CASE WHEN s >= 0.5 THEN doc_id END AS evidence_id, s >= 0.5 AS supported, round(s, 6) AS entailment FROM p WHERE n = 1""")
def calibration_labels(spark, sf_dir):
    """The judge picks among a passage's five best documents; put once into an append-only log, which is read."""
    j = retrieval.reranked(spark, sf_dir, 5, 1)
    ok = F.col("rerank_score") >= 0.5
    rows = j.select("q_id", F.when(ok, F.col("doc_id")).alias("evidence_id"), ok.alias("supported"), F.round("rerank_score", 6).alias("entailment"))
    path = scratch(spark, "calibration-labels")
    log = KeyedLog(spark, path, "q_id")
    log.put(rows)
    held = log.read()
    return rows if held is None else held.select(*rows.columns)


@query("""SELECT source AS step, 'completed' AS status, strlen(c)::BIGINT AS bytes, sha256(c) AS sha256 FROM (SELECT source, source || ': ' || count(*) || ' documents, ' || sum(n_chars)::BIGINT || ' characters' || chr(10) AS c FROM documents GROUP BY source)
 UNION ALL SELECT 'figures', 'missing', NULL, NULL""")
def submission_manifest(spark, sf_dir):
    """Each step of a run with the bytes and the digest of the file that it has left; a step without a file is missing."""
    path = scratch(spark, "submission")
    said = F.concat("source", F.lit(": "), F.count("*"), F.lit(" documents, "), F.sum("n_chars"), F.lit(" characters\n"))
    reports = documents(spark, sf_dir).groupBy("source").agg(said.alias("content"))
    log = corpus.write_documents(reports, path, F.lit("report"), F.col("source"), F.col("content"), suffix=".txt")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    steps = spark.read.json(log).select(F.col("url").alias("step"), name("path").alias("name"))
    steps = steps.unionByName(spark.range(1).select(F.lit("figures").alias("step"), F.lit("figures.txt").alias("name")))
    left = files.artefact_hashes(spark, f"{path}/documents").select(name("path").alias("name"), "bytes", "sha256")
    return steps.join(left, "name", "left").select("step", F.when(F.col("sha256").isNull(), "missing").otherwise("completed").alias("status"), "bytes", "sha256")


@query(_oracles["valid_unique_pairs"])
def rule_rows_scan(spark, sf_dir):
    """Pairs with rule-made labels, kept as JSON lines, read back typed, and reduced to the valid and unique ones."""
    t = table(spark, sf_dir, "conversations")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    label = F.when(F.col("turn") % 4 < 3, F.element_at(F.array(F.lit("entailment"), F.lit("neutral"), F.lit("contradiction")), (F.col("turn") % 4 + 1).cast("int"))).otherwise("unclear")
    rows = t.select("conv_id", "turn", F.col("text").alias("premise")).join(after, ["conv_id", "turn"]).withColumn("label", label)
    path = scratch(spark, "rule-rows")
    rows.write.json(path)
    read = spark.read.schema("premise string, hypothesis string, label string, conv_id bigint, turn int").json(path)
    return normalise.valid_unique_pairs(read, ["conv_id", "turn"]).select("premise", "hypothesis", "label", "conv_id", "turn")
