"""Decisions, routing and roll-ups of verified clauses.

A clause row has clause_id, doc_id, risk_label, risk_score, simplification_status,
semantic_target_met, n_evidence, fk_grade, and sentences: array of struct (source,
regulatory, chunk_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

TAU, LOW_ENTAILMENT, CONFLICT_GAP, HIGH_RISK = 0.376, 0.376, 0.3, 4

#: The reason codes, in the order in which they are reported.
REASONS = [
    "SIMPLIFICATION_GATE_FAILED", "RISK_ABSTENTION", "LOW_SOURCE_ENTAILMENT", "MISSING_REGULATORY_ATTRIBUTION", "CRITICAL_FACT_CHANGED", "EVIDENCE_CONFLICT", "HIGH_IMPACT_RISK",
]
#: Risk labels and their ordinal scores.
RISK_SCORES = {"Auto-Renewal": 4, "Hidden Fee": 3, "Liability Waiver": 4, "Data Sharing": 3, "Penalty Clause": 3, "Safe": 1}


def risk_score(label: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in RISK_SCORES.items() for x in kv))[label]


def primary(source: Column, regulatory: Column, mode: str = "retrieved_chunk", tau: float = TAU) -> Column:
    """struct(score, supported, reason) by the premise that decides: source_clause, retrieved_chunk or dual."""
    reg = F.coalesce(regulatory, F.lit(0.0))
    by_source = F.lit("source clause does not entail sentence")
    by_reg = F.when(regulatory.isNull(), "no regulatory evidence was retrieved").otherwise("retrieved evidence does not entail sentence")
    if mode == "source_clause":
        score, reason = source, by_source
    elif mode == "dual":
        score, reason = F.least(source, reg), F.when(source < tau, by_source).otherwise(by_reg)
    else:
        score, reason = reg, by_reg
    return F.struct(score.alias("score"), (score >= tau).alias("supported"), F.when(score < tau, reason).alias("reason"))


def routing_reasons(policy: str = "legacy") -> Column:
    failed = F.when(F.col("simplification_status") == "needs_review", F.lit(REASONS[0]))
    abstained = F.when(F.col("risk_label") == "Needs Review", F.lit(REASONS[1]))
    if policy != "strict_policy":
        return F.array_compact(F.array(failed, abstained))
    some = lambda f: F.coalesce(F.exists("sentences", f), F.lit(False))
    attributed = F.size(F.filter("sentences", lambda s: s["chunk_id"].isNotNull()))
    return F.array_compact(F.array(
        failed, abstained,
        F.when(some(lambda s: F.coalesce(s["source"] < LOW_ENTAILMENT, F.lit(False))), F.lit(REASONS[2])),
        F.when((F.col("n_evidence") > 0) & (attributed <= 0), F.lit(REASONS[3])),
        F.when(F.col("semantic_target_met") == F.lit(False), F.lit(REASONS[4])),
        F.when(some(lambda s: F.coalesce(F.abs(s["source"] - s["regulatory"]) >= CONFLICT_GAP, F.lit(False))), F.lit(REASONS[5])),
        F.when(F.col("risk_score") >= HIGH_RISK, F.lit(REASONS[6])),
    ))


def routed(clauses: DataFrame, policy: str = "legacy") -> DataFrame:
    return clauses.withColumn("reasons", routing_reasons(policy)).withColumn("routed", F.size("reasons") > 0)


def routing_summary(routed_clauses: DataFrame) -> DataFrame:
    """reason, n for every reason code, those that don't occur too."""
    dim = routed_clauses.sparkSession.createDataFrame(list(enumerate(REASONS)), "ordinal int, reason string")
    n = routed_clauses.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return dim.join(n, "reason", "left").select("reason", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def clause_means(clauses: DataFrame) -> DataFrame:
    """Means and rates over each clause's own sentences, by higher-order functions; null without sentences."""
    n = F.size("sentences")
    mean = lambda f: X.rounded(F.try_divide(F.aggregate(F.filter("sentences", lambda s: s[f].isNotNull()), F.lit(0.0), lambda a, s: a + s[f]), F.size(F.filter("sentences", lambda s: s[f].isNotNull()))), 6)
    rate = lambda g: X.rounded(F.try_divide(F.size(F.filter("sentences", g)), n), 6)
    return clauses.select(
        "clause_id", mean("source").alias("mean_source"), mean("regulatory").alias("mean_regulatory"),
        rate(lambda s: F.coalesce(s["regulatory"], F.lit(0.0)) < TAU).alias("unsupported_rate"), rate(lambda s: s["chunk_id"].isNotNull()).alias("attribution_coverage"),
    )


#: Names of the same figure, new and old.
ALIASES = (("unsupported_flag_rate", "hallucination_rate"), ("supported_attribution_coverage", "attribution_coverage"))


def with_aliases(rows: DataFrame) -> DataFrame:
    """Each of two names of a figure takes the other's value where it is null or missing."""
    for pair in ALIASES:
        have = [F.col(c) for c in pair if c in rows.columns]
        rows = rows.withColumns({c: F.coalesce(*([F.col(c)] if c in rows.columns else []), *have) for c in pair})
    return rows


def clause_results(clauses: DataFrame, mode: str = "retrieved_chunk", tau: float = TAU) -> DataFrame:
    """The clauses with means over their sentences; rates and coverages are null without sentences.

    ``mean_faithfulness`` is the primary mean, or the source mean where that is null or 0.
    """
    said = F.transform("sentences", lambda s: F.struct(s["source"].alias("source"), s["regulatory"].alias("regulatory"), s["chunk_id"].alias("chunk_id"), primary(s["source"], s["regulatory"], mode, tau)["score"].alias("primary")))
    c = clauses.withColumn("said", said)
    n = F.nullif(F.size("said"), F.lit(0))
    known = lambda f: F.filter("said", lambda s: s[f].isNotNull())
    mean = lambda f: X.rounded(F.try_divide(F.aggregate(known(f), F.lit(0.0), lambda a, s: a + s[f]), F.size(known(f))), 6)
    rate = lambda g: X.rounded(F.try_divide(F.size(F.filter("said", g)), n), 6)
    out = c.withColumns({
        "mean_source_faithfulness": mean("source"), "mean_regulatory_support": mean("regulatory"), "mean_primary_faithfulness": mean("primary"),
        "unsupported_flag_rate": rate(lambda s: s["primary"] < tau), "supported_attribution_coverage": rate(lambda s: s["chunk_id"].isNotNull()),
        "retrieval_coverage": F.when(n.isNotNull(), F.when(F.col("n_evidence") > 0, 1.0).otherwise(0.0)),
    })
    return with_aliases(out.withColumn("mean_faithfulness", F.coalesce(F.nullif("mean_primary_faithfulness", F.lit(0.0)), "mean_source_faithfulness"))).drop("said")


def document_metrics(clauses: DataFrame) -> DataFrame:
    """One row per document: means weigh sentences, not clauses; counts and shares are of clauses."""
    flat = clauses.select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.*")
    bad = F.coalesce("regulatory", F.lit(0.0)) < TAU
    by_sentence = flat.groupBy("doc_id").agg(
        F.count("*").alias("sentence_count"), F.count_if(bad).alias("unsupported_sentence_count"), X.rounded(F.avg("source"), 6).alias("mean_source_faithfulness"),
        X.rounded(F.avg("regulatory"), 6).alias("mean_regulatory_support"), X.rounded(F.avg(bad.cast("double")), 6).alias("unsupported_flag_rate"),
        X.rounded(F.avg(F.col("chunk_id").isNotNull().cast("double")), 6).alias("supported_attribution_coverage"),
    )
    share = lambda c: X.rounded(F.avg(c.cast("double")), 6)
    by_clause = clauses.groupBy("doc_id").agg(
        F.count("*").alias("clause_count"), F.count_if(~F.col("risk_label").isin("Safe", "Needs Review")).alias("risky_clause_count"), F.count_if(F.col("risk_label") == "Needs Review").alias("needs_review_count"),
        F.count_if(F.col("simplification_status") == "needs_review").alias("simplification_review_count"), share(F.col("n_evidence") > 0).alias("retrieval_coverage"), X.rounded(F.avg("fk_grade"), 6).alias("mean_fk_grade"),
        share(F.col("fk_grade") <= 8).alias("pct_fk_le_8"), share(F.col("fk_grade") <= 9).alias("pct_fk_le_9"), share(F.col("semantic_target_met")).alias("pct_semantic_target_met"), F.count_if("routed").alias("routed_clause_count"),
    )
    return by_clause.join(by_sentence, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("sentence_count", "unsupported_sentence_count")})


def risk_violations() -> Column:
    """What is wrong with a risk prediction (risk_label, risk_score, confidence, cited, retrieved, secondary)."""
    checks = [
        (F.size(F.array_except("cited", "retrieved")) > 0, "cites what was not retrieved"), (F.array_contains("secondary", F.col("risk_label")), "primary label is also secondary"), (F.size("secondary") > 3, "more than three secondary labels"),
        ((F.col("risk_label") == "Safe") & ((F.col("risk_score") > 2) | (F.size("cited") > 0)), "safe with high score or citations"), ((F.col("risk_label") == "Needs Review") & (F.col("confidence") > 0.5), "abstains with confidence"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in checks)))


def rule_label(text: Column, rules: dict[str, list[str]], otherwise: str = "Safe") -> Column:
    """The label with most of its terms in the text, the first on ties; ``otherwise`` without any."""

    def best(low: Column) -> Column:
        score = lambda terms: sum((low.contains(t).cast("int") for t in terms), F.lit(0))
        return F.array_max(F.array(*(F.struct(score(terms).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("label")) for i, (name, terms) in enumerate(rules.items()))))

    return X.let(X.let(F.lower(text), best), lambda b: F.when(b["n"] > 0, b["label"]).otherwise(otherwise))
