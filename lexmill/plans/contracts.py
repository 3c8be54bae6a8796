"""Clause queries: segmentation, risk, verification, routing and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import text as X
from ..operators import report as P
from ..operators import segment, verify
from .retrieval import bm25_sql, lexical, texts
from .text import SENTENCES_SQL, documents

#: Terms that do occur in the fixture's invented prose, one list per label.
RULES = {"Auto-Renewal": ["ertion", "and the"], "Hidden Fee": ["der ", "und"], "Liability Waiver": ["que ", "les "], "Data Sharing": ["ción", "los "], "Penalty Clause": ["license", "of the"]}

_HEAD = "(len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')) <= 12 AND (regexp_full_match(line, '[A-Z][A-Z0-9 /&(),.''-]{3,100}') OR line LIKE '%:'))"
_NUM = r"regexp_matches(line, '(?is)^\s*((?:\((?:\d+(?:\.\d+)*|[A-Z]|[IVXLC]+)\)|\d+(?:\.\d+)+(?:[.)])?|\d+[.)]|[A-Z][.)]|[IVXLC]+[.)]))\s*(.*)$')"


def _candidates_sql(head: str, line: str) -> str:
    return rf"""l AS (SELECT doc_id, pos, trim(line) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(ls) WITH ORDINALITY AS t(line, pos) WHERE trim(line) <> ''),
 h AS (SELECT *, {head} AS head FROM l), s AS (SELECT *, last_value(CASE WHEN head THEN regexp_replace(line, '\s+', ' ', 'g') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section,
  CASE WHEN {_NUM} OR coalesce(lag(head) OVER (PARTITION BY doc_id ORDER BY pos), true) THEN 1 ELSE 0 END AS starts FROM h),
 g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM s WHERE NOT head),
 c AS (SELECT * FROM (SELECT doc_id, grp, trim(regexp_replace(string_agg({line}, ' ' ORDER BY pos), '\s+', ' ', 'g')) AS clause, arg_max(section, pos) AS section FROM g GROUP BY doc_id, grp) WHERE clause <> '')"""


@query(f"""WITH {_candidates_sql(_HEAD, 'line')}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS clause_no, printf('C%04d', row_number() OVER (PARTITION BY doc_id ORDER BY grp)) AS clause_id, section, substr(sha256(clause), 1, 12) AS digest FROM c""")
def clause_segmentation(spark, sf_dir):
    c = segment.clauses(documents(spark, sf_dir), ["doc_id"], "text")
    return c.select("doc_id", "clause_no", "clause_id", "section", X.sha_prefix("clause", 12).alias("digest"))


_SPACED = f"CASE WHEN {_NUM} THEN trim({_NUM.replace('regexp_matches', 'regexp_extract')[:-1]}, 1) || ' ' || trim({_NUM.replace('regexp_matches', 'regexp_extract')[:-1]}, 2))) ELSE line END"


@query(rf"""WITH {_candidates_sql(_HEAD, _SPACED)},
 k AS (SELECT *, regexp_full_match(clause, '(?i)(?:\d+(?:\.\d+)*|[A-Z]|[IVXLC]+)[.)]') OR len(string_split(clause, ' ')) < 3 AS short, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS n FROM c),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS from_end FROM k WHERE NOT short),
 e AS (SELECT doc_id, clause FROM k WHERE short QUALIFY n = max(n) OVER (PARTITION BY doc_id) AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = k.doc_id AND f.n > k.n))
SELECT f.doc_id, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.n) AS clause_no, printf('C%04d', row_number() OVER (PARTITION BY f.doc_id ORDER BY f.n)) AS clause_id, coalesce(f.section, p.section) AS section,
 concat_ws(' ', p.clause, f.clause, CASE WHEN from_end = 1 THEN e.clause END) AS clause FROM f LEFT JOIN k p ON p.doc_id = f.doc_id AND p.n = f.n - 1 AND p.short LEFT JOIN e ON e.doc_id = f.doc_id""")
def clause_segmentation_fold(spark, sf_dir):
    return segment.fold_clauses(documents(spark, sf_dir), ["doc_id"], "text")


@query(r"""WITH l AS (SELECT source, doc_id AS page, pos, trim(line) AS line, len(ls) AS n FROM (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(ls) WITH ORDINALITY AS t(line, pos) WHERE trim(line) <> ''),
 p AS (SELECT source, count(DISTINCT page) AS pages FROM l GROUP BY source), r AS (SELECT source, line FROM l JOIN p USING (source) WHERE (pos = 1 OR pos = n) AND length(line) <= 160 GROUP BY source, line, pages HAVING pages >= 2 AND count(DISTINCT page) >= greatest(2, ceil(pages * 0.05)))
SELECT source, count(*) AS n_blocks, count(DISTINCT page) AS n_pages FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source = l.source AND r.line = l.line) GROUP BY source""")
def margin_block_removal(spark, sf_dir):
    split = F.split("text", "\n")
    blocks = documents(spark, sf_dir).select("source", F.col("doc_id").alias("page"), F.posexplode(split).alias("pos", "line"), F.size(split).alias("n"))
    blocks = blocks.withColumn("line", F.trim("line")).where("line <> ''")
    edge = (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)
    kept = segment.drop_margin_blocks(blocks, "source", "page", "line", edge, share=0.05)
    return kept.groupBy("source").agg(F.count("*").alias("n_blocks"), F.count_distinct("page").alias("n_pages"))


def _rules_sql(text: str) -> str:
    terms = ["(" + " + ".join(f"contains(lower({text}), '{t}')::INT" for t in ts) + ")" for ts in RULES.values()]
    best = f"greatest({', '.join(terms)})"
    return f"CASE WHEN {best} = 0 THEN 'Safe' " + " ".join(f"WHEN {t} = {best} THEN '{n}'" for n, t in zip(RULES, terms, strict=True)) + " END"


_SCORES = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.RISK_SCORES.items()) + " END"


@query(f"SELECT doc_id, l AS risk_label, ({_SCORES.format('l')})::BIGINT AS risk_score FROM (SELECT doc_id, {_rules_sql('text')} AS l FROM documents)")
def risk_rules(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", P.rule_label(F.col("text"), RULES).alias("risk_label"))
    return d.withColumn("risk_score", P.risk_score(F.col("risk_label")).cast("bigint"))


_TOKS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_RECALL = f"round(coalesce(len(list_intersect({_TOKS.format('{0}')}, {_TOKS.format('{1}')})) / nullif(len(list_distinct({_TOKS.format('{0}')})), 0), 0), 9)"
_VERIFIED = f"""{bm25_sql()}, sent AS (SELECT item_id AS clause_id, pos, trim(s) AS sentence, text AS clause FROM (SELECT item_id, text, {SENTENCES_SQL} AS ss FROM benchmark), unnest(ss) WITH ORDINALITY AS t(s, pos)),
 ev AS (SELECT q_id AS clause_id, rank, doc_id AS chunk_id, text FROM rk JOIN documents USING (doc_id) WHERE rank <= 5),
 pr AS (SELECT s.clause_id, s.pos, s.sentence, s.clause, e.chunk_id, e.rank, {_RECALL.format('s.sentence', 'e.text')} AS sc FROM sent s LEFT JOIN ev e ON e.clause_id = s.clause_id),
 bs AS (SELECT *, row_number() OVER (PARTITION BY clause_id, pos ORDER BY sc DESC, rank) AS rn FROM pr),
 vf AS (SELECT clause_id, pos, {_RECALL.format('sentence', 'clause')} AS source, CASE WHEN chunk_id IS NOT NULL THEN sc END AS regulatory, chunk_id AS candidate_chunk, CASE WHEN sc >= 0.8 THEN chunk_id END AS chunk_id, coalesce(sc, 0) >= 0.8 AS supported FROM bs WHERE rn = 1)"""


def verified(spark, sf_dir, tau=0.8):
    b = table(spark, sf_dir, "benchmark")
    sentences = b.select(F.col("item_id").alias("clause_id"), F.posexplode(X.sentences("text")).alias("pos", "sentence"), F.col("text").alias("clause")).withColumn("pos", (F.col("pos") + 1).cast("bigint"))
    ev = lexical(spark, sf_dir, 5).join(texts(spark, sf_dir), "doc_id").select(F.col("q_id").alias("clause_id"), "rank", F.col("doc_id").alias("chunk_id"), "text")
    return verify.verify(sentences, ev, tau, tau)


@query(f"WITH {_VERIFIED} SELECT clause_id, pos, round(source, 6) AS source, round(regulatory, 6) AS regulatory, candidate_chunk, chunk_id, supported FROM vf")
def sentence_evidence_argmax(spark, sf_dir):
    return verified(spark, sf_dir).select("clause_id", "pos", F.round("source", 6).alias("source"), F.round("regulatory", 6).alias("regulatory"), "candidate_chunk", "chunk_id", "supported")


@query(f"""WITH {_VERIFIED} SELECT clause_id, count(*) AS n_sentences, count(*) FILTER (WHERE supported) AS n_supported, round(avg(coalesce(regulatory, 0)), 6) AS mean_support, round(avg(CASE WHEN chunk_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM vf GROUP BY clause_id""")
def explanation_attribution(spark, sf_dir):
    v = verified(spark, sf_dir)
    return v.groupBy("clause_id").agg(
        F.count("*").alias("n_sentences"), F.count_if("supported").alias("n_supported"), F.round(F.avg(F.coalesce("regulatory", F.lit(0.0))), 6).alias("mean_support"),
        F.round(F.avg(F.col("chunk_id").isNotNull().cast("double")), 6).alias("coverage"),
    )


@query(f"""WITH {_VERIFIED} SELECT clause_id, pos, mode, round(score, 6) AS score, score >= 0.8 AS supported, CASE WHEN score < 0.8 THEN CASE WHEN mode = 'source_clause' OR (mode = 'dual' AND source < 0.8) THEN 'source clause does not entail sentence'
 WHEN regulatory IS NULL THEN 'no regulatory evidence was retrieved' ELSE 'retrieved evidence does not entail sentence' END END AS reason
FROM (SELECT *, CASE mode WHEN 'source_clause' THEN source WHEN 'dual' THEN least(source, coalesce(regulatory, 0)) ELSE coalesce(regulatory, 0) END AS score FROM vf, (SELECT unnest(['source_clause', 'retrieved_chunk', 'dual']) AS mode))""")
def primary_decisions(spark, sf_dir):
    v = verified(spark, sf_dir)
    modes = ("source_clause", "retrieved_chunk", "dual")
    made = F.array(*(F.struct(F.lit(m).alias("mode"), P.primary(F.col("source"), F.col("regulatory"), m, 0.8).alias("d")) for m in modes))
    x = v.select("clause_id", "pos", F.explode(made).alias("x"))
    return x.select("clause_id", "pos", "x.mode", F.round("x.d.score", 6).alias("score"), "x.d.supported", "x.d.reason")


def made_clauses(spark, sf_dir):
    """Clause results made from the documents by arithmetic; they stand in for model output."""
    i = F.col("doc_id")
    labels = F.array(*map(F.lit, [*P.RISK_SCORES, "Needs Review"]))
    d = documents(spark, sf_dir).select(i.alias("clause_id"), F.col("source").alias("doc_id"), i.alias("i"), F.element_at(labels, (i % 7 + 1).cast("int")).alias("risk_label"))
    i = F.col("i")
    sentence = lambda k: F.struct(
        ((i * 37 + k * 11) % 100 / 100.0).alias("source"), F.when(i % 5 != 0, (i * 53 + k * 29) % 100 / 100.0).alias("regulatory"),
        F.when((i % 5 != 0) & ((i * 53 + k * 29) % 100 / 100.0 >= P.TAU), F.concat(F.lit("c"), (i + k).cast("string"))).alias("chunk_id"),
    )
    empty = F.array().cast("array<struct<source:double,regulatory:double,chunk_id:string>>")
    return d.select(
        "clause_id", "doc_id", "risk_label", F.coalesce(P.risk_score(F.col("risk_label")), F.lit(3)).alias("risk_score"), F.when(i % 9 == 0, "needs_review").otherwise("accepted").alias("simplification_status"),
        F.when(i % 11 == 0, None).otherwise(i % 4 != 0).alias("semantic_target_met"), (i % 4).alias("n_evidence"), F.when(i % 13 == 0, None).otherwise((i * 7 % 15).cast("double")).alias("fk_grade"),
        F.when(i % 4 > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(i % 4, F.lit(1))), sentence)).otherwise(empty).alias("sentences"),
    )


_LAB = "['Auto-Renewal', 'Hidden Fee', 'Liability Waiver', 'Data Sharing', 'Penalty Clause', 'Safe', 'Needs Review']"
CLAUSES = f"""cl0 AS (SELECT doc_id AS clause_id, source AS doc_id, doc_id AS i, {_LAB}[doc_id % 7 + 1] AS risk_label FROM documents),
 cl AS (SELECT clause_id, doc_id, i, risk_label, coalesce({_SCORES.format('risk_label')}, 3) AS risk_score, CASE WHEN i % 9 = 0 THEN 'needs_review' ELSE 'accepted' END AS simplification_status,
  CASE WHEN i % 11 = 0 THEN NULL ELSE i % 4 <> 0 END AS semantic_target_met, i % 4 AS n_evidence, CASE WHEN i % 13 = 0 THEN NULL ELSE (i * 7 % 15)::DOUBLE END AS fk_grade FROM cl0),
 se AS (SELECT clause_id, doc_id, i, k, ((i * 37 + k * 11) % 100) / 100.0::DOUBLE AS source, CASE WHEN i % 5 <> 0 THEN ((i * 53 + k * 29) % 100) / 100.0::DOUBLE END AS regulatory FROM cl, range(1, 4) AS r(k) WHERE k <= i % 4),
 sa AS (SELECT clause_id, count(*) AS n, count(*) FILTER (WHERE source < 0.376) AS low, count(*) FILTER (WHERE abs(source - regulatory) >= 0.3) AS conflict, count(*) FILTER (WHERE regulatory >= 0.376) AS attributed,
  avg(source) AS ms, avg(regulatory) AS mr, count(*) FILTER (WHERE coalesce(regulatory, 0) < 0.376) AS bad FROM se GROUP BY clause_id),
 ro AS (SELECT cl.*, n, ms, mr, bad, attributed, list_filter([CASE WHEN simplification_status = 'needs_review' THEN 'SIMPLIFICATION_GATE_FAILED' END, CASE WHEN risk_label = 'Needs Review' THEN 'RISK_ABSTENTION' END,
  CASE WHEN low > 0 THEN 'LOW_SOURCE_ENTAILMENT' END, CASE WHEN n_evidence > 0 AND coalesce(attributed, 0) = 0 THEN 'MISSING_REGULATORY_ATTRIBUTION' END, CASE WHEN semantic_target_met = false THEN 'CRITICAL_FACT_CHANGED' END,
  CASE WHEN conflict > 0 THEN 'EVIDENCE_CONFLICT' END, CASE WHEN risk_score >= 4 THEN 'HIGH_IMPACT_RISK' END], lambda x: x IS NOT NULL) AS strict,
  list_filter([CASE WHEN simplification_status = 'needs_review' THEN 'SIMPLIFICATION_GATE_FAILED' END, CASE WHEN risk_label = 'Needs Review' THEN 'RISK_ABSTENTION' END], lambda x: x IS NOT NULL) AS legacy FROM cl LEFT JOIN sa USING (clause_id))"""


@query(f"WITH {CLAUSES} SELECT clause_id, array_to_string(legacy, ',') AS legacy_reasons, array_to_string(strict, ',') AS strict_reasons FROM ro")
def review_routing(spark, sf_dir):
    return made_clauses(spark, sf_dir).select("clause_id", F.array_join(P.routing_reasons("legacy"), ",").alias("legacy_reasons"), F.array_join(P.routing_reasons("strict_policy"), ",").alias("strict_reasons"))


@query(f"WITH {CLAUSES}, c AS (SELECT unnest({P.REASONS}) AS reason), x AS (SELECT unnest(strict) AS reason FROM ro) SELECT c.reason, count(x.reason) AS n FROM c LEFT JOIN x USING (reason) GROUP BY c.reason")
def routing_summary(spark, sf_dir):
    return P.routing_summary(P.routed(made_clauses(spark, sf_dir), "strict_policy"))


@query(f"WITH {CLAUSES} SELECT clause_id, round(ms, 6) AS mean_source, round(mr, 6) AS mean_regulatory, round(bad / n, 6) AS unsupported_rate, round(attributed / n, 6) AS attribution_coverage FROM ro")
def clause_means(spark, sf_dir):
    return P.clause_means(made_clauses(spark, sf_dir))


@query(f"""WITH {CLAUSES}, s AS (SELECT doc_id, count(*) AS sentence_count, count(*) FILTER (WHERE coalesce(regulatory, 0) < 0.376) AS unsupported_sentence_count, round(avg(source), 6) AS mean_source_faithfulness, round(avg(regulatory), 6) AS mean_regulatory_support,
 round(avg((coalesce(regulatory, 0) < 0.376)::INT), 6) AS unsupported_flag_rate, round(avg(coalesce(regulatory >= 0.376, false)::INT), 6) AS supported_attribution_coverage FROM se GROUP BY doc_id)
SELECT doc_id, count(*) AS clause_count, count(*) FILTER (WHERE risk_label NOT IN ('Safe', 'Needs Review')) AS risky_clause_count, count(*) FILTER (WHERE risk_label = 'Needs Review') AS needs_review_count, count(*) FILTER (WHERE simplification_status = 'needs_review') AS simplification_review_count,
 round(avg((n_evidence > 0)::INT), 6) AS retrieval_coverage, round(avg(fk_grade), 6) AS mean_fk_grade, round(avg((fk_grade <= 8)::INT), 6) AS pct_fk_le_8, round(avg((fk_grade <= 9)::INT), 6) AS pct_fk_le_9, round(avg(semantic_target_met::INT), 6) AS pct_semantic_target_met,
 count(*) FILTER (WHERE len(strict) > 0) AS routed_clause_count, coalesce(any_value(s.sentence_count), 0) AS sentence_count, coalesce(any_value(s.unsupported_sentence_count), 0) AS unsupported_sentence_count, any_value(s.mean_source_faithfulness) AS mean_source_faithfulness,
 any_value(s.mean_regulatory_support) AS mean_regulatory_support, any_value(s.unsupported_flag_rate) AS unsupported_flag_rate, any_value(s.supported_attribution_coverage) AS supported_attribution_coverage FROM ro LEFT JOIN s USING (doc_id) GROUP BY doc_id""")
def document_metrics(spark, sf_dir):
    return P.document_metrics(P.routed(made_clauses(spark, sf_dir), "strict_policy"))


@query(f"""WITH p AS (SELECT doc_id, {_LAB}[doc_id % 7 + 1] AS risk_label, doc_id % 5 + 1 AS risk_score, (doc_id * 13 % 100) / 100.0::DOUBLE AS confidence, [doc_id % 3, doc_id % 8] AS cited, [0, 1, 2, 3, 4] AS retrieved, {_LAB}[1:doc_id % 5] AS secondary FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN len(list_filter(cited, lambda c: NOT list_contains(retrieved, c))) > 0 THEN 'cites what was not retrieved' END, CASE WHEN list_contains(secondary, risk_label) THEN 'primary label is also secondary' END,
 CASE WHEN len(secondary) > 3 THEN 'more than three secondary labels' END, CASE WHEN risk_label = 'Safe' AND (risk_score > 2 OR len(cited) > 0) THEN 'safe with high score or citations' END, CASE WHEN risk_label = 'Needs Review' AND confidence > 0.5 THEN 'abstains with confidence' END], lambda x: x IS NOT NULL), '; ') AS violations FROM p""")
def risk_output_validation(spark, sf_dir):
    i, labels = F.col("doc_id"), F.array(*map(F.lit, [*P.RISK_SCORES, "Needs Review"]))
    p = documents(spark, sf_dir).select(
        "doc_id", F.element_at(labels, (i % 7 + 1).cast("int")).alias("risk_label"), (i % 5 + 1).alias("risk_score"), (i * 13 % 100 / 100.0).alias("confidence"), F.array(i % 3, i % 8).alias("cited"),
        F.array(*(F.lit(x).cast("bigint") for x in range(5))).alias("retrieved"), F.slice(labels, F.lit(1), (i % 5).cast("int")).alias("secondary"),
    )
    return p.select("doc_id", F.array_join(P.risk_violations(), "; ").alias("violations"))
