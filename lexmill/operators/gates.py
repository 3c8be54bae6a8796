"""Gates, guards and small decisions of an evaluation run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .metrics import div


def circular_gold(rows: DataFrame, gold: str, pool: str, other_pool: str) -> DataFrame:
    """Adds circular (the gold id is in its own pool) and same_pool (two pools are equal and not empty)."""
    return rows.select(
        "*", F.coalesce(F.array_contains(pool, F.col(gold)), F.lit(False)).alias("circular"),
        ((F.size(pool) > 0) & (F.array_sort(F.array_distinct(pool)) == F.array_sort(F.array_distinct(other_pool)))).alias("same_pool"),
    )


def asserted(rows: DataFrame, bad: Column, message: str) -> DataFrame:
    """The rows, unless one is bad: then the query fails with the message."""
    return rows.where(F.when(bad, F.raise_error(F.lit(message)).isNull()).otherwise(True))


def final_gate(records: DataFrame, reviewed: Column, evidence: Column, provisional: Column) -> DataFrame:
    """One row: counts, and whether final metrics may be reported."""
    c = records.agg(F.count("*").alias("n"), F.count_if(reviewed).alias("n_reviewed"), F.count_if(~evidence).alias("n_without_evidence"), F.count_if(provisional).alias("n_provisional"))
    ready = (F.col("n") > 0) & (F.col("n_reviewed") == F.col("n")) & (F.col("n_without_evidence") == 0) & (F.col("n_provisional") == 0)
    return c.withColumn("ready", ready)


def not_mergeable(runs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """run_a, run_b, field: the headline fields in which two runs differ, nulls being equal."""
    a = runs.select(F.col(key).alias("run_a"), *(F.col(f).cast("string").alias(f"a_{f}") for f in fields))
    b = runs.select(F.col(key).alias("run_b"), *(F.col(f).cast("string").alias(f"b_{f}") for f in fields))
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields)))
    return a.join(b, F.col("run_a") < F.col("run_b")).select("run_a", "run_b", F.explode(differ).alias("field"))  # a registry of runs, not data


def source_mix(rows: DataFrame, source: str, requested: dict[str, int], least: float = 0.8) -> DataFrame:
    """source, requested, actual, met: whether each source gave ``least`` of what was asked."""
    want = rows.sparkSession.createDataFrame(list(requested.items()), "source string, requested bigint")
    have = rows.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("have"))
    actual = F.least("requested", F.coalesce("have", F.lit(0).cast("bigint")))
    return want.join(have, "source", "left").select("source", "requested", actual.alias("actual"), (actual >= F.col("requested") * least).alias("met"))


def cost_rollup(calls: DataFrame, system: str, ms: str, tokens_in: str, tokens_out: str, price_in: float, price_out: float) -> DataFrame:
    """system, n, mean latency, calls a second, tokens, and cost by prices per million tokens."""
    a = calls.groupBy(system).agg(F.count("*").alias("n"), F.avg(ms).alias("mean"), F.sum(ms).alias("total"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"))
    cost = (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6
    return a.select(system, "n", F.round("mean", 4).alias("mean_ms"), F.round(div(F.col("n") * 1000.0, F.col("total")), 4).alias("per_second"), "tokens_in", "tokens_out", F.round(cost, 6).alias("cost"))


def fit_temperature(logits: DataFrame, columns: list[str], label: str, temperatures: list[float]) -> DataFrame:
    """temperature, nll, best: mean negative log-likelihood of softmax(logits / T) for each T of a grid."""
    t = logits.sparkSession.createDataFrame([(float(x),) for x in temperatures], "temperature double")
    z = [F.col(c) / F.col("temperature") for c in columns]
    top = F.greatest(*z)
    norm = top + F.log(sum((F.exp(x - top) for x in z), F.lit(0.0)))
    own = F.element_at(F.array(*z), F.col(label).cast("int") + 1)
    nll = logits.crossJoin(F.broadcast(t)).groupBy("temperature").agg(F.round(F.avg(norm - own), 9).alias("nll"))
    return nll.withColumn("best", F.row_number().over(Window.orderBy("nll", "temperature")) == 1)


def resolve_tag(wanted: str, tags: DataFrame) -> DataFrame:
    """The installed tag for a wanted model: itself, else the first that it begins, else the first of its family."""
    rank = F.when(F.col("tag") == wanted, 0).when(F.col("tag").startswith(wanted), 1).when(F.substring_index("tag", ":", 1) == wanted.split(":")[0], 2)
    return tags.withColumn("rank", rank).where("rank is not null").orderBy("rank", "tag").limit(1).select("tag")


def review_sheet(records: DataFrame, key: str, n: int, seed: int, reviewers: int, shown: list[str], hidden: list[str], blinded: bool) -> DataFrame:
    """A seeded sample of records with blank answer columns for each reviewer; a blinded sheet lacks the system's labels."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    blank = [F.lit(None).cast("string").alias(f"reviewer_{i}_{q}") for i in range(1, reviewers + 1) for q in ("supported", "evidence", "risk")]
    return records.orderBy(order).limit(n).select(key, *shown, *([] if blinded else hidden), *blank, *(F.lit(None).cast("string").alias(f"adjudicated_{q}") for q in ("supported", "chunk_id", "risk")))


def risk_confirmation(rows: DataFrame, least: int = 4) -> DataFrame:
    """Adds reasons why a provisional label isn't confirmed: no judge, another label, a low score."""
    p = F.col("provisional")
    reasons = F.array_compact(F.array(
        F.when(p & F.col("judge_label").isNull(), F.lit("judge missing")), F.when(p & (X.label_key("judge_label") != X.label_key("risk_label")), F.lit("judge disagrees")), F.when(p & (F.col("judge_score") < least), F.lit("judge unsure")),
    ))
    return rows.withColumn("reasons", reasons)


def plan_acceptance(plan: DataFrame, seed: int, taxonomy: Column, labels: list[str]) -> DataFrame:
    """rule, passed of a one-row plan (accepted, seed, taxonomy_sha256, labels); a missing value fails its rule."""
    want = F.array(*map(F.lit, labels))
    rules = {
        "accepted": F.col("accepted"), "seed": F.col("seed") == seed, "taxonomy": F.col("taxonomy_sha256") == taxonomy,
        "labels": X.subset_of(F.col("labels"), want) & X.subset_of(want, F.col("labels")),
    }
    return named_checks(plan, {k: ("error", v) for k, v in rules.items()}).select(F.col("name").alias("rule"), "passed")


def named_checks(facts: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """name, severity, passed of each check over one row of facts; a null doesn't pass."""
    rows = (F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.coalesce(c, F.lit(False)).alias("passed")) for n, (s, c) in checks.items())
    return facts.select(F.inline(F.array(*rows)))


def preflight(facts: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """``named_checks`` with ready: no check of severity error failed."""
    found = named_checks(facts, checks)
    ready = found.agg(F.coalesce(F.bool_and(F.when(F.col("severity") == "error", F.col("passed"))), F.lit(True)).alias("ready"))
    return found.crossJoin(F.broadcast(ready))  # one row


def judged_variants(variants: DataFrame, metrics: DataFrame, assessments: DataFrame, source: str, key: str, judge: str) -> DataFrame:
    """source, variants: each variant with its metrics and its judge's assessment (null where none came), in the order of ``key``.

    Metrics are joined by the variant's key, which is what their position stood for.
    """
    m = metrics.select(key, F.struct(*(c for c in metrics.columns if c != key)).alias("metrics"))
    a = assessments.select(judge, F.struct(*(c for c in assessments.columns if c != judge)).alias("assessment"))
    every = variants.join(m, key, "left").join(a, judge, "left")
    row = F.struct(key, *(c for c in variants.columns if c not in (key, source)), "metrics", "assessment")
    return every.groupBy(source).agg(F.array_sort(F.collect_list(row), lambda x, y: F.when(x[key] < y[key], -1).when(x[key] > y[key], 1).otherwise(0)).alias("variants"))  # a few a source


def fixed_hypothesis(records: DataFrame, transformed: DataFrame, source: str, score: Column) -> DataFrame:
    """Each record with its source's transformed clause and the pair's score; sources without one go."""
    return records.join(transformed, source).withColumn("score", score)


def picked_evidence(rows: DataFrame, picked: str, pool: str, supported: str) -> DataFrame:
    """A judge's choice counts only if it is one of the candidates: else the id is null and nothing is supported."""
    ok = F.coalesce(F.array_contains(pool, F.col(picked)), F.lit(False))
    return rows.withColumns({picked: F.when(ok, F.col(picked)), supported: ok & F.coalesce(F.col(supported), F.lit(False))})
