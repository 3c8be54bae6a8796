"""Evaluation queries over the labelled documents, with stand-in scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import metrics as M

TAUS = (0.3, 0.376, 0.5, 0.65)
#: Labelled documents with the scores of three made-up systems; they stand in for models and measure none.
BASE = """base AS (SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.text, least(d.n_chars / 2000.0::DOUBLE, 1.0::DOUBLE) AS s1, (l.doc_id * 7919 % 1000) / 1000.0::DOUBLE AS s2,
 (least(d.n_chars / 2000.0::DOUBLE, 1.0::DOUBLE) + (l.doc_id * 7919 % 1000) / 1000.0::DOUBLE) / 2 AS s3 FROM labels l JOIN documents d USING (doc_id))"""


def labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    s1, s2 = F.least(F.col("n_chars") / 2000.0, F.lit(1.0)), (F.col("doc_id") * 7919 % 1000) / 1000.0
    return j.withColumn("s1", s1).withColumn("s2", s2).withColumn("s3", (s1 + s2) / 2)


def system_scores(spark, sf_dir):
    """doc_id, quality, system, score in long form."""
    b = labelled(spark, sf_dir)
    return b.select("doc_id", "quality", F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.col(s).alias("score")) for s in ("s1", "s2", "s3")))).alias("x")).select("doc_id", "quality", "x.system", "x.score")


LONG = "long AS (SELECT doc_id, quality, 's1' AS system, s1 AS score FROM base UNION ALL SELECT doc_id, quality, 's2', s2 FROM base UNION ALL SELECT doc_id, quality, 's3', s3 FROM base)"
_COUNTS = "count(*) FILTER (WHERE quality = 1 AND {p}) AS tp, count(*) FILTER (WHERE quality = 0 AND {p}) AS fp, count(*) FILTER (WHERE quality = 1 AND NOT {p}) AS fn, count(*) FILTER (WHERE quality = 0 AND NOT {p}) AS tn"
_D = "coalesce(({}) / nullif({}, 0), 0.0)"
_P, _R, _UP, _UR = _D.format("tp", "tp + fp"), _D.format("tp", "tp + fn"), _D.format("tn", "tn + fn"), _D.format("tn", "tn + fp")
_F1 = "coalesce(2 * {0} * {1} / nullif({0} + {1}, 0), 0.0)"
_N = "tp + fp + fn + tn"
METRICS = f"""{_N} AS n, tp, fp, fn, tn, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F1.format(_P, _R)}, 6) AS f1, round({_UP}, 6) AS unsupported_precision, round({_UR}, 6) AS unsupported_recall,
 round({_F1.format(_UP, _UR)}, 6) AS unsupported_f1, round((tp + tn) / ({_N}), 6) AS accuracy, round((fn + tn) / ({_N}), 6) AS predicted_unsupported_rate, round((fp + tn) / ({_N}), 6) AS true_unsupported_rate,
 round({_D.format('fp', 'fp + tn')}, 6) AS missed_unsupported_rate, round(({_R} + {_UR}) / 2, 6) AS balanced_accuracy"""


def swept(rows, keys, taus, score="score"):
    t = rows.sparkSession.createDataFrame([(float(x),) for x in taus], "tau double")
    counted = M.binary_counts(rows.crossJoin(F.broadcast(t)), [*keys, "tau"], F.col("quality"), F.col(score) >= F.col("tau"))
    return M.binary_metrics(counted, [*keys, "tau"])


@query(f"WITH {BASE} SELECT {METRICS} FROM (SELECT {_COUNTS.format(p='s1 >= 0.376')} FROM base)")
def binary_metrics(spark, sf_dir):
    return M.binary_metrics(M.binary_counts(labelled(spark, sf_dir), [], F.col("quality"), F.col("s1") >= 0.376), [])


@query(f"WITH {BASE} SELECT tau, {METRICS} FROM (SELECT tau, {_COUNTS.format(p='s1 >= tau')} FROM base, (SELECT unnest([0.3, 0.376, 0.5, 0.65])::DOUBLE AS tau) GROUP BY tau)")
def tau_sweep(spark, sf_dir):
    return swept(labelled(spark, sf_dir), [], TAUS, "s1")


@query(f"""WITH {BASE}, t AS (SELECT tau, {METRICS} FROM (SELECT tau, {_COUNTS.format(p='s1 >= tau')} FROM base, (SELECT unnest(range(20, 96)) / 100.0::DOUBLE AS tau) GROUP BY tau)),
 c AS (SELECT 'precision_90' AS rule, tau, precision, recall, f1 FROM t WHERE precision >= 0.9 UNION ALL SELECT 'unconstrained', tau, precision, recall, f1 FROM t)
SELECT rule, tau, precision, recall, f1 FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY recall DESC, f1 DESC, tau) AS rn FROM c) WHERE rn = 1""")
def threshold_selection(spark, sf_dir):
    t = swept(labelled(spark, sf_dir), [], [i / 100 for i in range(20, 96)], "s1").select("tau", "precision", "recall", "f1")
    both = t.where(F.col("precision") >= 0.9).withColumn("rule", F.lit("precision_90")).unionByName(t.withColumn("rule", F.lit("unconstrained")))
    best = both.groupBy("rule").agg(F.max_by(F.struct("tau", "precision", "recall", "f1"), F.struct("recall", "f1", -F.col("tau"))).alias("b"))
    return best.select("rule", "b.*")


_EDGES = " + ".join(f"(CASE WHEN c >= {i}/10.0::DOUBLE THEN 1 ELSE 0 END)" for i in range(1, 10))


@query(f"""WITH {BASE}, k AS (SELECT least(greatest(s3, 0), 1) AS c, CASE WHEN (s3 >= 0.5) = (quality = 1) THEN 1.0 ELSE 0.0 END AS ok FROM base), b AS (SELECT {_EDGES} AS bin, c, ok FROM k),
 g AS (SELECT bin, count(*) AS n, avg(ok) AS acc, avg(c) AS mean, sum((c - ok) * (c - ok)) AS bs FROM b GROUP BY bin)
SELECT bin::BIGINT AS bin, bin / 10.0::DOUBLE AS lower, (bin + 1) / 10.0::DOUBLE AS upper, n, round(acc, 6) AS accuracy, round(mean, 6) AS mean_confidence, round(n / sum(n) OVER () * abs(acc - mean), 6) AS ece_part, round(bs, 6) AS brier_sum FROM g""")
def calibration_bins(spark, sf_dir):
    return M.calibration_bins(labelled(spark, sf_dir), (F.col("s3") >= 0.5) == (F.col("quality") == 1), F.col("s3"))


@query(f"""WITH {BASE}, k AS (SELECT least(greatest(s3, 0), 1) AS c, CASE WHEN (s3 >= 0.5) = (quality = 1) THEN 1.0 ELSE 0.0 END AS ok FROM base), b AS (SELECT {_EDGES} AS bin, c, ok FROM k),
 g AS (SELECT bin, count(*) AS n, avg(ok) AS acc, avg(c) AS mean, sum((c - ok) * (c - ok)) AS bs FROM b GROUP BY bin)
SELECT round(sum(e), 5) AS ece, round(sum(bs) / sum(n), 5) AS brier, sum(n)::BIGINT AS n FROM (SELECT round(n / sum(n) OVER () * abs(acc - mean), 6) AS e, bs, n FROM g)""")
def calibration_summary(spark, sf_dir):
    b = calibration_bins(spark, sf_dir)
    return b.agg(F.round(F.sum("ece_part"), 5).alias("ece"), F.round(F.sum("brier_sum") / F.sum("n"), 5).alias("brier"), F.sum("n").alias("n"))


LANGS = ["en", "de", "fr", "es"]
_GUESS = "CASE WHEN length(text) < 60 THEN 'unknown' WHEN contains(text, 'ß') OR contains(text, 'ü') THEN 'de' WHEN contains(text, 'ñ') OR contains(text, 'ó') THEN 'es' WHEN contains(text, 'è') OR contains(text, 'ê') THEN 'fr' ELSE 'en' END"


def guessed(spark, sf_dir):
    has = lambda *cs: F.exists(F.array(*map(F.lit, cs)), lambda c: F.contains("text", c))
    g = F.when(F.length("text") < 60, "unknown").when(has("ß", "ü"), "de").when(has("ñ", "ó"), "es").when(has("è", "ê"), "fr").otherwise("en")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", g.alias("guess"))


_CLS = f"""g AS (SELECT lang, {_GUESS} AS guess FROM documents), lab AS (SELECT unnest(['en', 'de', 'fr', 'es']) AS label),
 pc AS (SELECT label, (SELECT count(*) FROM g WHERE lang = label) AS support, (SELECT count(*) FROM g WHERE guess = label) AS predicted, (SELECT count(*) FROM g WHERE guess = label AND lang = label) AS tp FROM lab),
 pr AS (SELECT label, support, predicted, tp, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall,
  round(coalesce(2 * (tp / nullif(predicted, 0)) * (tp / nullif(support, 0)) / nullif(tp / nullif(predicted, 0) + tp / nullif(support, 0), 0), 0), 6) AS f1 FROM pc)"""


@query(f"WITH {_CLS} SELECT label, support, predicted, tp, precision, recall, f1 FROM pr")
def risk_per_class(spark, sf_dir):
    return M.per_class(M.confusion(guessed(spark, sf_dir), LANGS, "lang", "guess"), LANGS).select("label", "support", "predicted", F.col("tp").cast("bigint").alias("tp"), "precision", "recall", "f1")


@query(f"""WITH {_CLS} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, (SELECT count(*) FROM g) AS n,
 (SELECT round(avg(CASE WHEN lang = guess THEN 1.0 ELSE 0.0 END), 6) FROM g) AS accuracy, (SELECT count(*) FROM g WHERE guess NOT IN ('en', 'de', 'fr', 'es')) AS n_invalid,
 (SELECT round(avg(CASE WHEN guess NOT IN ('en', 'de', 'fr', 'es') THEN 1.0 ELSE 0.0 END), 6) FROM g) AS invalid_rate FROM pr""")
def risk_multiclass_metrics(spark, sf_dir):
    return M.multiclass_metrics(guessed(spark, sf_dir), LANGS, "lang", "guess")


@query(f"""WITH g AS (SELECT lang, {_GUESS} AS guess FROM documents), l AS (SELECT unnest(['en', 'de', 'fr', 'es', '__OTHER__']) AS x)
SELECT a.x AS true_label, b.x AS pred_label, (SELECT count(*) FROM g WHERE lang = a.x AND CASE WHEN guess IN ('en', 'de', 'fr', 'es') THEN guess ELSE '__OTHER__' END = b.x) AS n FROM l a, l b""")
def risk_confusion_matrix(spark, sf_dir):
    return M.confusion(guessed(spark, sf_dir), LANGS, "lang", "guess")


@query(f"""WITH {BASE}, {LONG}, c AS (SELECT doc_id, system, (score >= 0.5) = (quality = 1) AS ok FROM long),
 d AS (SELECT a.system AS system_a, b.system AS system_b, count(*) FILTER (WHERE a.ok AND NOT b.ok) AS b, count(*) FILTER (WHERE b.ok AND NOT a.ok) AS c FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.system < b.system GROUP BY ALL)
SELECT system_a, system_b, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 6) END AS p_value FROM d""")
def mcnemar_pairs(spark, sf_dir):
    c = system_scores(spark, sf_dir).select("doc_id", "system", ((F.col("score") >= 0.5) == (F.col("quality") == 1)).alias("ok"))
    a, b = c.select("doc_id", F.col("system").alias("system_a"), F.col("ok").alias("ok_a")), c.select("doc_id", F.col("system").alias("system_b"), F.col("ok").alias("ok_b"))
    pairs = a.join(b, "doc_id").where("system_a < system_b")
    return M.mcnemar(pairs, ["system_a", "system_b"], F.col("ok_a"), F.col("ok_b"))


@query(f"""WITH {BASE}, {LONG}, k AS (SELECT 'toxic_quality' AS pair, quality AS a, 1 - toxic AS b FROM base UNION ALL SELECT 'quality_s1', quality, CASE WHEN s1 >= 0.376 THEN 1 ELSE 0 END FROM base),
 n AS (SELECT pair, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(a) AS pa, avg(b) AS pb FROM k GROUP BY pair)
SELECT pair, n, round((po - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0), 6) AS kappa FROM n""")
def cohen_kappa(spark, sf_dir):
    b = labelled(spark, sf_dir)
    pairs = b.select(F.explode(F.array(
        F.struct(F.lit("toxic_quality").alias("pair"), F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")),
        F.struct(F.lit("quality_s1").alias("pair"), F.col("quality").alias("a"), F.when(F.col("s1") >= 0.376, 1).otherwise(0).alias("b")),
    )).alias("x")).select("x.*")
    return M.cohen_kappa(pairs, ["pair"], "a", "b")


@query(f"""WITH {BASE}, r AS (SELECT doc_id, unnest([quality, 1 - toxic, CASE WHEN s1 >= 0.376 THEN 1 ELSE 0 END]) AS cat FROM base), c AS (SELECT doc_id, cat, count(*) AS n FROM r GROUP BY ALL),
 p AS (SELECT avg(a) AS p, count(*) AS m FROM (SELECT doc_id, (sum(n * n) - 3) / 6.0 AS a FROM c GROUP BY doc_id)), e AS (SELECT sum(s * s) AS pe FROM (SELECT sum(n) / (SELECT sum(n) FROM c) AS s FROM c GROUP BY cat))
SELECT m AS n_subjects, round((p - pe) / (1 - pe), 6) AS kappa FROM p, e""")
def fleiss_kappa(spark, sf_dir):
    b = labelled(spark, sf_dir)
    rated = b.select("doc_id", F.posexplode(F.array(F.col("quality"), 1 - F.col("toxic"), F.when(F.col("s1") >= 0.376, 1).otherwise(0))).alias("rater", "cat"))
    return M.fleiss_kappa(rated, "doc_id", "rater", "cat")


@query(f"""WITH {BASE}, o AS (SELECT 1 + (s1 * 4)::DECIMAL(18, 9)::BIGINT AS e, 1 + (s3 * 4)::DECIMAL(18, 9)::BIGINT AS p FROM base), n AS (SELECT count(*) AS n FROM o),
 w AS (SELECT sum((e - p) * (e - p)) AS seen FROM o), c AS (SELECT sum((a.e - b.p) * (a.e - b.p)) AS chance FROM o a, o b)
SELECT (SELECT round(avg(abs(e - p)), 6) FROM o) AS mae, n, round(1 - seen * n / chance, 6) AS quadratic_weighted_kappa FROM n, w, c""")
def ordinal_agreement(spark, sf_dir):
    grade = lambda c: 1 + F.round((F.col(c) * 4).cast("decimal(18,9)"), 0).cast("bigint")
    return M.ordinal_agreement(labelled(spark, sf_dir).select(grade("s1").alias("e"), grade("s3").alias("p")), "e", "p")


@query(f"""WITH {BASE}, e AS (SELECT CASE WHEN quality = 0 THEN 'false_supported' ELSE 'false_unsupported' END AS kind, doc_id, round(abs(s3 - 0.5), 9) AS distance FROM base WHERE (s3 >= 0.5) <> (quality = 1))
SELECT kind, rank, doc_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY distance, doc_id) AS rank FROM e) WHERE rank <= 20""")
def nearest_boundary_errors(spark, sf_dir):
    wrong = labelled(spark, sf_dir).where((F.col("s3") >= 0.5) != (F.col("quality") == 1))
    e = wrong.select(F.when(F.col("quality") == 0, "false_supported").otherwise("false_unsupported").alias("kind"), "doc_id", F.round(F.abs(F.col("s3") - 0.5), 9).alias("distance"))
    w = Window.partitionBy("kind").orderBy("distance", "doc_id")
    return e.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 20").select("kind", "rank", "doc_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {BASE}, {LONG} SELECT system, tau, {METRICS} FROM (SELECT system, tau, {_COUNTS.format(p='score >= tau')} FROM long, (SELECT unnest([0.3, 0.376, 0.5, 0.65])::DOUBLE AS tau) GROUP BY ALL)")
def multi_verifier_table(spark, sf_dir):
    return swept(system_scores(spark, sf_dir), ["system"], TAUS)


@query(f"""WITH {BASE} SELECT {METRICS} FROM (SELECT {_COUNTS.format(p='s1 >= 0.376')} FROM base WHERE doc_id IN (SELECT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)) OR toxic = 0)""")
def retrieval_conditioned_metrics(spark, sf_dir):
    from .retrieval import gold

    found = gold(spark, sf_dir).select("doc_id").distinct().withColumn("retrieved", F.lit(True))
    rows = labelled(spark, sf_dir).join(found, "doc_id", "left").where(F.col("retrieved").isNotNull() | (F.col("toxic") == 0))
    return M.binary_metrics(M.binary_counts(rows, [], F.col("quality"), F.col("s1") >= 0.376), [])


@query(f"""WITH {BASE} SELECT source, count(*) AS n, round(max(abs(s1 - s3)), 6) AS max_delta, max(abs(s1 - s3)) >= 0.02 AS attached, round(avg(s1), 6) AS mean_s1,
 abs(round(avg(s1), 6) - round(avg(s3), 6)) <= 0.05 AS reproduced FROM base GROUP BY source""")
def adapter_and_tolerance_gates(spark, sf_dir):
    gap = F.max(F.abs(F.col("s1") - F.col("s3")))
    b = labelled(spark, sf_dir)
    return b.groupBy("source").agg(
        F.count("*").alias("n"), F.round(gap, 6).alias("max_delta"), (gap >= 0.02).alias("attached"), F.round(F.avg("s1"), 6).alias("mean_s1"),
        (F.abs(F.round(F.avg("s1"), 6) - F.round(F.avg("s3"), 6)) <= 0.05).alias("reproduced"),
    )


@query(f"""WITH {BASE} SELECT lang, count(*) AS n, (SELECT count(*) FROM base) / (4 * greatest(1, count(*)))::DOUBLE AS class_weight FROM base GROUP BY lang""")
def class_weights(spark, sf_dir):
    c = labelled(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    kinds = F.count("*").over(Window.partitionBy())
    return c.select("lang", "n", (total / (kinds * F.greatest(F.lit(1), F.col("n")))).alias("class_weight"))
