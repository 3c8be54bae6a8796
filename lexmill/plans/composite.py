"""Whole experiments put together from the other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import query, table
from ..functions import text as X
from ..operators import report as P
from ..operators import retrieval as R
from ..operators import segment, stress, verify
from ..operators.matching import tasks
from ..operators.stages import StageStore, shared_stages
from ..session import scratch, stored
from . import contracts, evaluation, resampling, retrieval
from .text import _NEG, _NUM, FK_SQL, SENTENCES_SQL, documents

#: Report section -> (query, its metric columns).
SECTIONS = {
    "retrieval": ("multi_gold_retrieval_metrics", ["recall", "precision", "mrr", "ndcg", "hit_at_1"]),
    "hybrid": ("hybrid_retrieval_metrics", ["recall", "mrr", "ndcg"]),
    "support": ("binary_metrics", ["precision", "recall", "f1", "accuracy", "missed_unsupported_rate"]),
    "risk": ("risk_multiclass_metrics", ["macro_precision", "macro_recall", "macro_f1", "accuracy", "invalid_rate"]),
    "calibration": ("calibration_summary", ["ece", "brier"]),
    "attribution": ("attribution_accuracy", ["accuracy", "coverage"]),
    "bootstrap": ("bootstrap_pr_ci", ["precision_lower", "precision_upper", "recall_lower", "recall_upper"]),
}
_BUILDERS = {f.__name__: f for m in (retrieval, evaluation, resampling, contracts) for f in vars(m).values() if callable(f) and getattr(f, "__module__", "") == m.__name__}
_REPORT = " UNION ALL ".join(
    f"SELECT '{s}' AS section, '{c}' AS metric, round({c}, 4) AS value FROM ({catalog._oracles[q]})" for s, (q, cols) in SECTIONS.items() for c in cols
)


def long_metrics(one_row: DataFrame, section: str, columns: list[str]) -> DataFrame:
    named = F.array(*(F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 4).alias("value")) for c in columns))
    return one_row.select(F.lit(section).alias("section"), F.explode(named).alias("x")).select("section", "x.metric", "x.value")


@query(_REPORT)
def benchmark_evaluate(spark, sf_dir):
    """All sections of the report; what several of them need (ranks, gold) is computed once for the run."""
    out = None
    with shared_stages(StageStore(spark, scratch(spark, "evaluate"))):
        for section, (name, columns) in SECTIONS.items():
            part = long_metrics(_BUILDERS[name](spark, sf_dir), section, columns)
            out = part if out is None else out.unionByName(part)
    return out


#: Targets of metrics, by the end of their names: operator and threshold.
TARGETS = {"f1": (">=", 0.75), "precision": (">=", 0.9), "recall": (">=", 0.8), "accuracy": (">=", 0.75), "ece": ("<=", 0.08)}


def against_targets(report: DataFrame) -> DataFrame:
    """Adds target and status: pass, fail, missing (no value) or reported (no target)."""
    target, ok = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name, (op, t) in TARGETS.items():
        hit = F.col("metric").endswith(name)
        target = F.when(hit, f"{op} {t}").otherwise(target)
        ok = F.when(hit, F.col("value") >= t if op == ">=" else F.col("value") <= t).otherwise(ok)
    status = F.when(F.col("value").isNull(), "missing").when(target.isNull(), "reported").when(ok, "pass").otherwise("fail")
    return report.select("*", target.alias("target"), status.alias("status"))


_TARGET = "CASE WHEN metric LIKE '%ece' THEN '<= 0.08' WHEN metric LIKE '%accuracy' THEN '>= 0.75' WHEN metric LIKE '%recall' THEN '>= 0.8' WHEN metric LIKE '%precision' THEN '>= 0.9' WHEN metric LIKE '%f1' THEN '>= 0.75' END"
_OK = "CASE WHEN metric LIKE '%ece' THEN value <= 0.08 WHEN metric LIKE '%accuracy' THEN value >= 0.75 WHEN metric LIKE '%recall' THEN value >= 0.8 WHEN metric LIKE '%precision' THEN value >= 0.9 WHEN metric LIKE '%f1' THEN value >= 0.75 END"


@query(f"SELECT section, metric, value, {_TARGET} AS target, CASE WHEN value IS NULL THEN 'missing' WHEN {_TARGET} IS NULL THEN 'reported' WHEN {_OK} THEN 'pass' ELSE 'fail' END AS status FROM ({_REPORT})")
def consolidate_results(spark, sf_dir):
    return against_targets(benchmark_evaluate(spark, sf_dir))


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN value IS NULL THEN 'missing' WHEN {_TARGET} IS NULL THEN 'reported' WHEN {_OK} THEN 'pass' ELSE 'fail' END AS status FROM ({_REPORT})) GROUP BY status")
def verdict_counts(spark, sf_dir):
    return consolidate_results(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def analyse(docs: DataFrame, chunks: DataFrame, top_j: int = 3, tau: float = P.TAU, suppress: bool = False) -> DataFrame:
    """Clause results of whole contracts: segment, rewrite, retrieve, label, verify, route.

    One plan for all documents; models are their stand-ins.  Documents are dealt over tasks once, and
    a clause meets its evidence in its row.  With ``suppress`` a rewrite that wasn't accepted doesn't
    go on: the clause itself stands for it.
    """
    dealt = docs.repartition(tasks(docs.sparkSession), "doc_id")  # what follows takes long for its bytes
    cl = segment.fold_clauses(dealt, ["doc_id"], "text").select(F.concat_ws("/", "doc_id", "clause_id").alias("clause_id"), "doc_id", "clause")
    cl = cl.withColumn("rewritten", X.split_long_clauses("clause")).withColumn("said", X.sentences("rewritten")).withColumn("fk_grade", X.fk_grade("rewritten", F.size("said")))
    suppressed = (F.col("fk_grade") > 9) if suppress else F.lit(False)
    cl = cl.withColumn("suppressed", suppressed).withColumn("simplified", F.when(F.col("suppressed"), F.col("clause")).otherwise(F.col("rewritten")))
    if suppress:
        cl = cl.withColumn("said", F.when(F.col("suppressed"), X.sentences("clause")).otherwise(F.col("said")))
    judge = verify.in_rows(chunks, top_j, tau)
    cl = _judged_by_joins(cl, chunks, top_j, tau) if judge is None else cl.withColumn("judged", judge("clause", "said"))
    label = P.rule_label(F.col("clause"), contracts.RULES)
    return cl.select(
        "clause_id", "doc_id", label.alias("risk_label"), P.risk_score(label).alias("risk_score"), F.when(F.col("fk_grade") > 9, "needs_review").otherwise("accepted").alias("simplification_status"),
        X.critical_tokens_preserved("clause", "rewritten").alias("semantic_target_met"), "judged.n_evidence", "fk_grade", "judged.sentences", "simplified", F.col("suppressed").alias("simplification_suppressed"),
    )


def _judged_by_joins(cl: DataFrame, chunks: DataFrame, top_j: int, tau: float) -> DataFrame:
    """Adds what ``verify.in_rows`` gives, where the chunks are too many for it."""
    cl = stored(cl, "clauses")
    found = R.bm25(cl.select(F.col("clause_id").alias("q_id"), F.col("clause").alias("text")), chunks.select("doc_id", "text"), top_j)
    ev = found.join(chunks, "doc_id").select(F.col("q_id").alias("clause_id"), "rank", F.col("doc_id").alias("chunk_id"), "text")
    v = verify.verify(cl.select("clause_id", "clause", F.posexplode("said").alias("pos", "sentence")), ev, tau, tau)
    per = v.groupBy("clause_id").agg(F.collect_list(F.struct("source", "regulatory", F.col("chunk_id").cast("string").alias("chunk_id"))).alias("sentences"))  # a clause's sentences
    counts = ev.groupBy("clause_id").agg(F.count("*").alias("n_evidence"))
    empty = F.array().cast("array<struct<source:double,regulatory:double,chunk_id:string>>")
    judged = F.struct(F.coalesce("n_evidence", F.lit(0).cast("bigint")).alias("n_evidence"), F.coalesce("sentences", empty).alias("sentences"))
    return cl.join(per, "clause_id", "left").join(counts, "clause_id", "left").withColumn("judged", judged)


_CLAUSE_RULES = contracts._rules_sql("clause")
_REWRITE = catalog._oracles["clause_split_rewrite"].removeprefix("SELECT doc_id, ").removesuffix(" AS rewritten FROM documents")
_SHARED = "round(coalesce(len(list_intersect({0}, {1})) / nullif(len({0}), 0), 0), 9)"
#: Clauses of all documents, analysed: cs (sentences), ca (a row a clause), cr (with the strict policy's reasons).
ANALYSED = f"""cf AS (SELECT doc_id || '/' || clause_id AS clause_id, doc_id, clause FROM ({catalog._oracles["clause_segmentation_fold"]})),
 rw AS MATERIALIZED (SELECT clause_id, doc_id, clause, {_REWRITE} AS rewritten FROM (SELECT *, clause AS text FROM cf)),
 {retrieval.bm25_sql("SELECT clause_id AS q_id, clause AS text FROM rw").replace("FROM documents", "FROM (SELECT item_id AS doc_id, text FROM benchmark)")},
 bw AS (SELECT item_id, list_distinct({retrieval._TOK.format("text")}) AS words FROM benchmark), ev AS MATERIALIZED (SELECT q_id AS clause_id, rank, rk.doc_id AS chunk_id, words FROM rk JOIN bw ON bw.item_id = rk.doc_id WHERE rank <= 3),
 s0 AS (SELECT clause_id, doc_id, list_distinct({retrieval._TOK.format("clause")}) AS cw, pos, list_distinct({retrieval._TOK.format("s")}) AS sw FROM (SELECT *, {SENTENCES_SQL} AS ss FROM (SELECT *, rewritten AS text FROM rw)), unnest(ss) WITH ORDINALITY AS t(s, pos)),
 s1 AS (SELECT s0.clause_id, s0.doc_id, pos, {_SHARED.format("sw", "cw")} AS source, chunk_id, rank, CASE WHEN chunk_id IS NOT NULL THEN {_SHARED.format("sw", "words")} END AS sc FROM s0 LEFT JOIN ev USING (clause_id)),
 cs AS (SELECT clause_id, doc_id, pos, source, max(sc) AS regulatory, CASE WHEN max(sc) >= {P.TAU} THEN arg_max(chunk_id, (sc, -rank)) END AS chunk_id FROM s1 GROUP BY clause_id, doc_id, pos, source),
 cg AS (SELECT clause_id, count(*) AS n, count(*) FILTER (WHERE source < {P.LOW_ENTAILMENT}) AS low, count(*) FILTER (WHERE abs(source - regulatory) >= {P.CONFLICT_GAP}) AS conflict, count(chunk_id) AS attributed FROM cs GROUP BY clause_id),
 ce AS (SELECT clause_id, count(*) AS n_evidence FROM ev GROUP BY clause_id),
 ca AS (SELECT rw.clause_id, doc_id, clause, rewritten, risk_label, {contracts._SCORES.format("risk_label")} AS risk_score, fk_grade, CASE WHEN fk_grade > 9 THEN 'needs_review' ELSE 'accepted' END AS simplification_status, semantic_target_met, coalesce(n_evidence, 0) AS n_evidence, low, conflict, attributed
  FROM (SELECT *, {_CLAUSE_RULES} AS risk_label, {FK_SQL} AS fk_grade, len(list_filter({_NUM.format("rewritten")}, lambda x: NOT list_contains({_NUM.format("clause")}, x))) = 0 AND {_NEG.format("clause")} = {_NEG.format("rewritten")} AS semantic_target_met FROM (SELECT *, rewritten AS text FROM rw)) rw
  LEFT JOIN cg USING (clause_id) LEFT JOIN ce USING (clause_id)),
 cr AS (SELECT *, list_filter([CASE WHEN simplification_status = 'needs_review' THEN 'SIMPLIFICATION_GATE_FAILED' END, CASE WHEN risk_label = 'Needs Review' THEN 'RISK_ABSTENTION' END, CASE WHEN low > 0 THEN 'LOW_SOURCE_ENTAILMENT' END,
  CASE WHEN n_evidence > 0 AND coalesce(attributed, 0) = 0 THEN 'MISSING_REGULATORY_ATTRIBUTION' END, CASE WHEN semantic_target_met = false THEN 'CRITICAL_FACT_CHANGED' END, CASE WHEN conflict > 0 THEN 'EVIDENCE_CONFLICT' END, CASE WHEN risk_score >= {P.HIGH_RISK} THEN 'HIGH_IMPACT_RISK' END], lambda x: x IS NOT NULL) AS reasons FROM ca)"""
_DOCUMENT = f"""sd AS (SELECT doc_id, count(*) AS sentence_count, count(*) FILTER (WHERE coalesce(regulatory, 0) < {P.TAU}) AS unsupported_sentence_count, round(avg(source), 6) AS mean_source_faithfulness, round(avg(regulatory), 6) AS mean_regulatory_support,
 round(avg((coalesce(regulatory, 0) < {P.TAU})::INT), 6) AS unsupported_flag_rate, round(avg((chunk_id IS NOT NULL)::INT), 6) AS supported_attribution_coverage FROM cs GROUP BY doc_id)
SELECT doc_id, count(*) AS clause_count, count(*) FILTER (WHERE risk_label NOT IN ('Safe', 'Needs Review')) AS risky_clause_count, count(*) FILTER (WHERE risk_label = 'Needs Review') AS needs_review_count, count(*) FILTER (WHERE simplification_status = 'needs_review') AS simplification_review_count,
 round(avg((n_evidence > 0)::INT), 6) AS retrieval_coverage, round(avg(fk_grade), 6) AS mean_fk_grade, round(avg((fk_grade <= 8)::INT), 6) AS pct_fk_le_8, round(avg((fk_grade <= 9)::INT), 6) AS pct_fk_le_9, round(avg(semantic_target_met::INT), 6) AS pct_semantic_target_met,
 count(*) FILTER (WHERE len(reasons) > 0) AS routed_clause_count, coalesce(any_value(sentence_count), 0) AS sentence_count, coalesce(any_value(unsupported_sentence_count), 0) AS unsupported_sentence_count, any_value(mean_source_faithfulness) AS mean_source_faithfulness,
 any_value(mean_regulatory_support) AS mean_regulatory_support, any_value(unsupported_flag_rate) AS unsupported_flag_rate, any_value(supported_attribution_coverage) AS supported_attribution_coverage FROM cr LEFT JOIN sd USING (doc_id) GROUP BY doc_id"""


#: The same with unaccepted rewrites suppressed.
SUPPRESSED = ANALYSED.replace("FROM (SELECT *, rewritten AS text FROM rw)), unnest(ss)", f"FROM (SELECT * EXCLUDE (text, g), CASE WHEN g > 9 THEN clause ELSE rewritten END AS text FROM (SELECT *, {FK_SQL} AS g FROM (SELECT *, rewritten AS text FROM rw)))), unnest(ss)")


def _analysed(spark, sf_dir, suppress=False):
    chunks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return analyse(documents(spark, sf_dir).select("doc_id", "text"), chunks, suppress=suppress)


@query(f"WITH {ANALYSED}, {_DOCUMENT}")
def analyse_document(spark, sf_dir):
    clauses = stored(_analysed(spark, sf_dir).drop("simplified"), "analysed")  # metrics read them twice
    return P.document_metrics(P.routed(clauses, "strict_policy"))


@query(f"""WITH {SUPPRESSED}, cm AS (SELECT clause_id, count(*) AS n, round(avg(source), 6) AS ms, round(avg(regulatory), 6) AS mr, round(avg(coalesce(regulatory, 0)), 6) AS mp, round(avg((coalesce(regulatory, 0) < {P.TAU})::INT), 6) AS bad, round(avg((chunk_id IS NOT NULL)::INT), 6) AS att FROM cs GROUP BY clause_id)
SELECT clause_id, fk_grade > 9 AS simplification_suppressed, substr(sha256(CASE WHEN fk_grade > 9 THEN clause ELSE rewritten END), 1, 12) AS simplified_digest, ms AS mean_source_faithfulness, mr AS mean_regulatory_support, mp AS mean_primary_faithfulness, coalesce(nullif(mp, 0), ms) AS mean_faithfulness,
 bad AS unsupported_flag_rate, bad AS hallucination_rate, CASE WHEN n > 0 THEN (n_evidence > 0)::INT::DOUBLE END AS retrieval_coverage, att AS supported_attribution_coverage, att AS attribution_coverage FROM ca LEFT JOIN cm USING (clause_id)""")
def clause_results(spark, sf_dir):
    """Every clause's result with unaccepted rewrites suppressed and old names filled."""
    r = P.clause_results(_analysed(spark, sf_dir, suppress=True))
    means = [f"mean_{c}" for c in ("source_faithfulness", "regulatory_support", "primary_faithfulness", "faithfulness")]
    return r.select("clause_id", "simplification_suppressed", X.sha_prefix("simplified", 12).alias("simplified_digest"), *means, "unsupported_flag_rate", "hallucination_rate", "retrieval_coverage", "supported_attribution_coverage", "attribution_coverage")


@query(f"""WITH {retrieval.bm25_sql()}, {retrieval.GOLD}, v AS (SELECT 'full' AS variant, q_id, doc_id, rank FROM rk UNION ALL SELECT 'top_1', q_id, doc_id, rank FROM rk WHERE rank <= 1 UNION ALL SELECT 'top_3', q_id, doc_id, rank FROM rk WHERE rank <= 3),
 h AS (SELECT v.variant, g.q_id, g.doc_id, max((r.rank <= 10)::INT) AS hit FROM (SELECT DISTINCT variant FROM v) v CROSS JOIN gold g LEFT JOIN v r ON r.variant = v.variant AND r.q_id = g.q_id AND r.doc_id = g.doc_id GROUP BY ALL),
 p AS (SELECT variant, q_id, doc_id, coalesce(hit, 0) AS hit FROM h)
SELECT a.variant, round(avg(a.hit), 6) AS recall, round(avg(a.hit) - avg(f.hit), 6) AS delta, count(*) FILTER (WHERE f.hit = 1 AND a.hit = 0) AS lost, count(*) FILTER (WHERE f.hit = 0 AND a.hit = 1) AS won FROM p a JOIN p f ON f.variant = 'full' AND f.q_id = a.q_id AND f.doc_id = a.doc_id GROUP BY a.variant""")
def ablation_deltas(spark, sf_dir):
    ranks = retrieval.lexical(spark, sf_dir, 10).select("q_id", "doc_id", "rank")
    variants = [("full", 10), ("top_1", 1), ("top_3", 3)]
    g = retrieval.gold(spark, sf_dir).join(ranks, ["q_id", "doc_id"], "left")
    hits = g.select("q_id", "doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0)).alias("hit")) for n, k in variants))).alias("x")).select("q_id", "doc_id", "x.*")
    full = F.max(F.when(F.col("variant") == "full", F.col("hit"))).over(Window.partitionBy("q_id", "doc_id"))
    aligned = hits.withColumn("base", full)
    return aligned.groupBy("variant").agg(
        F.round(F.avg("hit"), 6).alias("recall"), F.round(F.avg("hit") - F.avg("base"), 6).alias("delta"), F.count_if((F.col("base") == 1) & (F.col("hit") == 0)).alias("lost"), F.count_if((F.col("base") == 0) & (F.col("hit") == 1)).alias("won"),
    )


@query(rf"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents),
 c AS (SELECT doc_id, 'baseline_clean' AS condition, text AS t FROM w UNION ALL SELECT doc_id, 'very_short_or_truncated', array_to_string(w[1:30], ' ') FROM w UNION ALL SELECT doc_id, 'unseen_jurisdiction', 'Under the law of an unspecified foreign jurisdiction, ' || text FROM w),
 l AS (SELECT condition, doc_id, {contracts._rules_sql('t')} AS label FROM c), b AS (SELECT doc_id, label FROM l WHERE condition = 'baseline_clean')
SELECT condition, l.label AS risk_label, count(*) AS n, count(*) FILTER (WHERE l.label = b.label) AS unchanged FROM l JOIN b USING (doc_id) GROUP BY ALL""")
def stress_risk_labels(spark, sf_dir):
    c = stress.under_conditions(documents(spark, sf_dir), ["doc_id"], "text", ["baseline_clean", "very_short_or_truncated", "unseen_jurisdiction"])
    labelled = c.select("doc_id", "condition", P.rule_label(F.col("text"), contracts.RULES).alias("risk_label"))
    base = F.max(F.when(F.col("condition") == "baseline_clean", F.col("risk_label"))).over(Window.partitionBy("doc_id"))
    return labelled.withColumn("base", base).groupBy("condition", "risk_label").agg(F.count("*").alias("n"), F.count_if(F.col("risk_label") == F.col("base")).alias("unchanged"))
