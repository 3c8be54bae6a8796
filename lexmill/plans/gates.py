"""Queries of the gates and of the model stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import _oracles, query, table
from ..functions import text as X
from ..operators import benchmark as B
from ..operators import gates as G
from ..operators import models
from ..session import children, file_status, scratch, ship
from ..sources import files as S
from .evaluation import BASE, labelled
from .text import FK_SQL, documents  # the SQL of the text functions is registered there


@query("""WITH r AS (SELECT doc_id, doc_id % 9 AS gold, [doc_id % 3, doc_id % 5, doc_id % 8] AS pool, CASE WHEN doc_id % 4 = 0 THEN [doc_id % 8, doc_id % 5, doc_id % 3] ELSE [doc_id % 2] END AS other FROM documents)
SELECT doc_id, list_contains(pool, gold) AS circular, list_sort(list_distinct(pool)) = list_sort(list_distinct(other)) AS same_pool FROM r""")
def circular_gold_guard(spark, sf_dir):
    i = F.col("doc_id")
    r = documents(spark, sf_dir).select("doc_id", (i % 9).alias("gold"), F.array(i % 3, i % 5, i % 8).alias("pool"), F.when(i % 4 == 0, F.array(i % 8, i % 5, i % 3)).otherwise(F.array(i % 2)).alias("other"))
    return G.circular_gold(r, "gold", "pool", "other").select("doc_id", "circular", "same_pool")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS n_reviewed, count(*) FILTER (WHERE n_chars < 100) AS n_without_evidence, count(*) FILTER (WHERE coalesce(toxic, 0) = 1) AS n_provisional,
 count(*) > 0 AND count(*) = count(l.doc_id) AND count(*) FILTER (WHERE n_chars < 100) = 0 AND count(*) FILTER (WHERE coalesce(toxic, 0) = 1) = 0 AS ready FROM documents d LEFT JOIN labels l USING (doc_id)""")
def final_evaluation_gate(spark, sf_dir):
    r = documents(spark, sf_dir).select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    return G.final_gate(r, F.coalesce("seen", F.lit(False)), F.col("n_chars") >= 100, F.coalesce(F.col("toxic") == 1, F.lit(False)))


_FIELDS = ["method", "tau", "top_k"]


@query("""WITH r AS (SELECT n_nationkey AS run, n_nationkey % 3 AS method, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey % 4 END AS tau, n_regionkey AS top_k FROM nation), p AS (SELECT a.run AS run_a, b.run AS run_b,
 unnest(list_filter([CASE WHEN a.method IS DISTINCT FROM b.method THEN 'method' END, CASE WHEN a.tau IS DISTINCT FROM b.tau THEN 'tau' END, CASE WHEN a.top_k IS DISTINCT FROM b.top_k THEN 'top_k' END], lambda x: x IS NOT NULL)) AS field FROM r a JOIN r b ON a.run < b.run)
SELECT run_a, run_b, field FROM p""")
def merge_compatibility(spark, sf_dir):
    k = F.col("n_nationkey")
    r = table(spark, sf_dir, "nation").select(k.alias("run"), (k % 3).alias("method"), F.when(k % 5 == 0, None).otherwise(k % 4).alias("tau"), F.col("n_regionkey").alias("top_k"))
    return G.not_mergeable(r, "run", _FIELDS)


@query("""WITH w AS (SELECT * FROM (VALUES ('en', 100), ('de', 40), ('fr', 40), ('xx', 10)) AS v(source, requested)), h AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT source, requested::BIGINT AS requested, least(requested, coalesce(n, 0))::BIGINT AS actual, least(requested, coalesce(n, 0)) >= requested * 0.8 AS met FROM w LEFT JOIN h ON h.lang = w.source""")
def source_mix_accounting(spark, sf_dir):
    return G.source_mix(documents(spark, sf_dir), "lang", {"en": 100, "de": 40, "fr": 40, "xx": 10})


@query("""SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_ms, round(count(*) * 1000.0::DOUBLE / sum(value), 4) AS per_second, sum(user_id)::BIGINT AS tokens_in, sum(event_id % 50)::BIGINT AS tokens_out,
 round((sum(user_id) * 0.15 + sum(event_id % 50) * 0.6) / 1e6, 6)::DOUBLE AS cost FROM events GROUP BY event_type""")
def latency_cost_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("out", F.col("event_id") % 50)
    return G.cost_rollup(e, "event_type", "value", "user_id", "out", 0.15, 0.6)


@query(f"""WITH {BASE}, t AS (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0])::DOUBLE AS temperature), n AS (SELECT temperature, round(avg(ln(exp(s1 * 4 / temperature) + exp(s2 * 2 / temperature)) - CASE WHEN quality = 0 THEN s1 * 4 / temperature ELSE s2 * 2 / temperature END), 9) AS nll FROM base, t GROUP BY temperature)
SELECT temperature, nll, row_number() OVER (ORDER BY nll, temperature) = 1 AS best FROM n""")
def temperature_fit(spark, sf_dir):
    z = labelled(spark, sf_dir).select((F.col("s1") * 4).alias("a"), (F.col("s2") * 2).alias("b"), "quality")
    return G.fit_temperature(z, ["a", "b"], "quality", [0.25, 0.5, 1.0, 2.0, 4.0])


@query("SELECT p_brand AS tag FROM (SELECT DISTINCT p_brand FROM part) ORDER BY CASE WHEN p_brand = 'Brand#1' THEN 0 WHEN starts_with(p_brand, 'Brand#1') THEN 1 ELSE 2 END, p_brand LIMIT 1")
def model_tag_resolution(spark, sf_dir):
    tags = table(spark, sf_dir, "part").select(F.col("p_brand").alias("tag")).distinct()
    return G.resolve_tag("Brand#1", tags)


@query("SELECT doc_id, lang, NULL::VARCHAR AS reviewer_1_supported, NULL::VARCHAR AS reviewer_1_evidence, NULL::VARCHAR AS reviewer_1_risk, NULL::VARCHAR AS reviewer_2_supported, NULL::VARCHAR AS reviewer_2_evidence, NULL::VARCHAR AS reviewer_2_risk, NULL::VARCHAR AS adjudicated_supported, NULL::VARCHAR AS adjudicated_chunk_id, NULL::VARCHAR AS adjudicated_risk FROM documents ORDER BY md5('11:' || doc_id) LIMIT 30")
def review_sheet_export(spark, sf_dir):
    return G.review_sheet(documents(spark, sf_dir), "doc_id", 30, 11, 2, ["lang"], ["source"], blinded=True)


@query("""WITH r AS (SELECT doc_id, doc_id % 3 = 0 AS provisional, 'Hidden Fee' AS risk_label, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'hidden-fee' ELSE 'Safe' END AS judge_label, doc_id % 6 AS judge_score FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN provisional AND judge_label IS NULL THEN 'judge missing' END, CASE WHEN provisional AND judge_label = 'Safe' THEN 'judge disagrees' END, CASE WHEN provisional AND judge_score < 4 THEN 'judge unsure' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM r""")
def risk_confirmation_gate(spark, sf_dir):
    i = F.col("doc_id")
    r = documents(spark, sf_dir).select("doc_id", (i % 3 == 0).alias("provisional"), F.lit("Hidden Fee").alias("risk_label"), F.when(i % 4 == 1, "hidden-fee").when(i % 4 > 1, "Safe").alias("judge_label"), (i % 6).alias("judge_score"))
    return G.risk_confirmation(r).select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


_PARTS = _oracles["clause_split_rewrite"].removeprefix("SELECT doc_id, ").removesuffix(" AS rewritten FROM documents")
_KEPT = "round(coalesce(len(list_intersect({0}, {1})) / nullif(len({0}), 0), 0), 9)".format(*(f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))" for c in ("text", "source")))


@query(f"""WITH p AS (SELECT item_id, text AS source, string_split(regexp_replace({_PARTS}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM benchmark),
 d AS (SELECT item_id, source, a AS attempt, array_to_string(parts[1:greatest(len(parts) - a + 1, 1)], ' ') AS text FROM p, range(1, 9) AS t(a)),
 s AS (SELECT item_id, attempt, {FK_SQL} AS grade, {_KEPT} AS entailment FROM d),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY entailment < 0.75, CASE WHEN entailment >= 0.75 THEN grade ELSE -entailment END, CASE WHEN entailment >= 0.75 THEN -entailment ELSE grade END, attempt) AS n FROM s)
SELECT item_id, attempt::INT AS attempt, grade, round(entailment, 6) AS entailment, grade <= 7 AND entailment >= 0.75 AS accepted FROM r WHERE n = 1""")
def rewrite_retries(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return models.rewrite_until_simple(b, "item_id", "text").select("item_id", "attempt", "grade", F.round("entailment", 6).alias("entailment"), "accepted")


@query()
def frozen_embedding_classifier(spark, sf_dir):
    ship(spark)
    classes = ["en", "de", "fr", "es"]
    d = documents(spark, sf_dir).select("doc_id", "lang", models.embed("text").alias("v"), X.hash_split(F.col("doc_id").cast("string")).alias("split"))
    fitted = models.train_classifier(d.where("split = 'train'"), "v", "lang", classes)
    p = models.predicted(fitted, d.where("split <> 'train'"), "v", classes)
    return p.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("lang") == F.col("predicted_label")).cast("double")), 3).alias("accuracy"))


@query(f"SELECT item_id, {FK_SQL} AS grade FROM benchmark")
def rewrite_grades(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.fk_grade("text").alias("grade"))


@query("""WITH f AS (SELECT vec_id, (label < 5) AS positive, row_number() OVER (ORDER BY (label < 5)::VARCHAR, md5(vec_id::VARCHAR), vec_id) - 1 AS idx FROM embeddings)
SELECT (idx % 5)::INT AS fold, count(*) AS n, count(*) FILTER (WHERE positive) AS n_positive, min(vec_id) AS first_id, sum(vec_id)::BIGINT AS id_sum FROM f GROUP BY idx % 5""")
def calibration_folds(spark, sf_dir):
    """Folds of equal classes for the calibration classifier."""
    v = table(spark, sf_dir, "embeddings").withColumn("positive", (F.col("label") < 5).cast("string"))
    f = models.stratified_folds(v, "vec_id", "positive").join(v.select("vec_id", "positive"), "vec_id")
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("positive") == "true").alias("n_positive"), F.min("vec_id").alias("first_id"), F.sum("vec_id").alias("id_sum"))


@query()
def calibration_classifier(spark, sf_dir):
    """Out-of-fold accuracy of a class-balanced classifier of the vectors, fold by fold."""
    v = table(spark, sf_dir, "embeddings").withColumn("positive", (F.col("label") < 5).cast("string"))
    p = models.out_of_fold(v, "vec_id", "embedding", "positive", ["false", "true"])
    return p.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg((F.col("positive") == F.col("predicted_label")).cast("double")), 3).alias("accuracy"))


@query("""SELECT doc_id, list_filter([CASE WHEN doc_id % 7 = 0 THEN 'quality' END, CASE WHEN doc_id % 5 = 0 THEN 'evidence' END], lambda x: x IS NOT NULL) AS missing FROM labels WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 ORDER BY doc_id LIMIT 5""")
def gold_not_ready(spark, sf_dir):
    """The first five labelled rows whose adjudication lacks something."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(i % 7 != 0, F.col("quality").cast("string")).alias("quality"), F.when(i % 5 != 0, F.concat(F.lit("c"), i)).otherwise(" ").alias("evidence"))
    return B.not_ready(rows, "doc_id", ["quality", "evidence"])


@query("""SELECT source AS variant, count(*) AS n, min(doc_id) AS first_id, (source NOT IN ('src0', 'src1'))::BOOLEAN AS written_by_second FROM documents GROUP BY source""")
def resumed_variants(spark, sf_dir):
    """Variants written one folder each; a run that ended after two goes on with the others only."""
    path = scratch(spark, "variants")
    rows = documents(spark, sf_dir).select("doc_id", F.col("source").alias("variant"))
    S.write_missing_variants(rows.where("variant in ('src0', 'src1')"), path, "variant")
    second = S.write_missing_variants(rows, path, "variant")
    read = spark.read.option("basePath", path).parquet(*(p for p in children(spark, path) if file_status(spark, f"{p}/_SUCCESS")))
    return read.groupBy("variant").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).withColumn("written_by_second", F.col("variant").isin(second))
