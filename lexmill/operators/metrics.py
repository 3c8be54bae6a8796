"""Evaluation metrics as aggregations; grouping columns are the only difference between variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def div(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    out = F.try_divide(a, b)
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def _f1(p: Column, r: Column) -> Column:
    return div(2 * p * r, p + r)


def binary_counts(rows: DataFrame, keys: list[str], label: Column, predicted: Column) -> DataFrame:
    c = lambda x: F.count_if(x)
    return rows.groupBy(*keys).agg(
        c((label == 1) & predicted).alias("tp"), c((label == 0) & predicted).alias("fp"), c((label == 1) & ~predicted).alias("fn"), c((label == 0) & ~predicted).alias("tn")
    )


def binary_metrics(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of both classes, accuracy, predicted and true unsupported rates, missed unsupported."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p, r, up, ur = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fn), div(tn, tn + fp)
    cols = {
        "precision": p, "recall": r, "f1": _f1(p, r), "unsupported_precision": up, "unsupported_recall": ur, "unsupported_f1": _f1(up, ur), "accuracy": div(tp + tn, n),
        "predicted_unsupported_rate": div(fn + tn, n), "true_unsupported_rate": div(fp + tn, n), "missed_unsupported_rate": div(fp, fp + tn),
        "balanced_accuracy": (r + ur) / 2,
    }
    return counts.select(*keys, n.alias("n"), "tp", "fp", "fn", "tn", *(F.round(v, 6).alias(k) for k, v in cols.items()))


def confusion(rows: DataFrame, labels: list[str], true: str, pred: str, other: str = "__OTHER__") -> DataFrame:
    """true_label, pred_label, n over the full grid of labels and ``other``."""
    spark = rows.sparkSession
    fold = lambda c: F.when(F.col(c).isin(labels), F.col(c)).otherwise(other)
    counted = rows.groupBy(fold(true).alias("true_label"), fold(pred).alias("pred_label")).agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(a, b) for a in [*labels, other] for b in [*labels, other]], "true_label string, pred_label string")
    return grid.join(counted, ["true_label", "pred_label"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def per_class(matrix: DataFrame, labels: list[str]) -> DataFrame:
    """label, support, predicted, tp, precision, recall, f1 from a confusion grid."""
    lab = matrix.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    stats = matrix.select(F.explode(F.array(F.struct(F.col("true_label").alias("label"), F.lit(1).alias("t")), F.struct(F.col("pred_label").alias("label"), F.lit(0).alias("t")))).alias("x"), "n", (F.col("true_label") == F.col("pred_label")).alias("hit"))
    agg = stats.groupBy("x.label").agg(
        F.sum(F.col("n") * F.col("x.t")).alias("support"), F.sum(F.col("n") * (1 - F.col("x.t"))).alias("predicted"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("x.t")).otherwise(0)).alias("tp")
    )
    p, r = div(F.col("tp"), F.col("predicted")), div(F.col("tp"), F.col("support"))
    return lab.join(agg, "label", "left").select("label", "support", "predicted", "tp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_f1(p, r), 6).alias("f1"))


def multiclass_metrics(rows: DataFrame, labels: list[str], true: str, pred: str) -> DataFrame:
    """One row: macro precision, recall, F1 over the fixed labels, raw accuracy, invalid predictions."""
    macro = per_class(confusion(rows, labels, true, pred), labels).agg(*(F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    raw = rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col(true) == F.col(pred)).cast("double")), 6).alias("accuracy"), F.count_if(~F.col(pred).isin(labels)).alias("n_invalid"))
    return macro.crossJoin(raw).withColumn("invalid_rate", F.round(div(F.col("n_invalid"), F.col("n")), 6))


def retrieval_single(top: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """One row of single-gold metrics: gold has (q_id, doc_id), one per query; top has q_id, doc_id, rank."""
    cut = top.where(F.col("rank") <= k)
    sizes = cut.groupBy("q_id").agg(F.count("*").alias("size"))
    hit = gold.join(cut.select("q_id", "doc_id", "rank"), ["q_id", "doc_id"], "left").join(sizes, "q_id", "left")
    r = F.col("rank")
    avg = lambda x: F.round(F.avg(F.coalesce(x, F.lit(0.0))), 6)
    return hit.agg(
        avg(F.when(r.isNotNull(), 1.0)).alias("recall"), avg(F.when(r.isNotNull(), 1.0 / F.col("size"))).alias("precision"), avg(1.0 / r).alias("mrr"),
        avg(1.0 / F.log2(r + 1)).alias("ndcg"), avg(F.when(r == 1, 1.0)).alias("hit_at_1"), F.count("*").alias("n_examples"),
    )


def per_query_multi(top: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """q_id, recall, precision, rr, ndcg, hit of queries with one or more relevant documents."""
    cut = top.where(F.col("rank") <= k)
    sizes = cut.groupBy("q_id").agg(F.count("*").alias("size"))
    relevant = gold.groupBy("q_id").agg(F.count("*").alias("relevant"))
    hits = cut.join(gold, ["q_id", "doc_id"]).groupBy("q_id").agg(F.count("*").alias("m"), F.min("rank").alias("best"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    q = relevant.join(sizes, "q_id", "left").join(hits, "q_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.least("relevant", F.lit(k).cast("bigint"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return q.select(
        "q_id", div(F.col("m"), F.col("relevant")).alias("recall"), div(F.col("m"), F.greatest("size", F.lit(1))).alias("precision"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"), div(F.col("dcg"), ideal).alias("ndcg"), F.when(F.col("best") == 1, 1.0).otherwise(0.0).alias("hit"),
    )


def retrieval_multi(top: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    q = per_query_multi(top, gold, k)
    names = {"recall": "recall", "precision": "precision", "rr": "mrr", "ndcg": "ndcg", "hit": "hit_at_1"}
    return q.agg(*(F.round(F.avg(a), 6).alias(b) for a, b in names.items()), F.count("*").alias("n_examples"))


def attribution(rows: DataFrame, predicted: str, expected: str) -> DataFrame:
    g = rows.where(F.col(expected).isNotNull())
    return g.agg(
        F.round(F.avg(F.coalesce((F.col(predicted) == F.col(expected)).cast("double"), F.lit(0.0))), 6).alias("accuracy"),
        F.coalesce(F.round(F.avg(F.col(predicted).isNotNull().cast("double")), 6), F.lit(0.0)).alias("coverage"), F.count("*").alias("n_examples"),
    )


def calibration_bins(rows: DataFrame, correct: Column, confidence: Column, bins: int = 10) -> DataFrame:
    """bin, lower, upper, n, accuracy, mean_confidence, ece_part, brier_sum; edges are half open, the last closed.

    Bins come from comparing with the edges themselves, not from rounding a product.
    """
    conf = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    edges = [i / bins for i in range(1, bins)]
    b = sum((F.when(conf >= e, 1).otherwise(0) for e in edges), F.lit(0))
    base = rows.select(b.alias("bin"), conf.alias("conf"), correct.cast("double").alias("ok"))
    grouped = base.groupBy("bin").agg(F.count("*").alias("n"), F.avg("ok").alias("acc"), F.avg("conf").alias("mean"), F.sum((F.col("conf") - F.col("ok")) ** 2).alias("brier_sum"))
    total = F.sum("n").over(Window.partitionBy())
    return grouped.select(
        F.col("bin").cast("bigint").alias("bin"), (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), "n", F.round("acc", 6).alias("accuracy"), F.round("mean", 6).alias("mean_confidence"),
        F.round(F.col("n") / total * F.abs(F.col("acc") - F.col("mean")), 6).alias("ece_part"), F.round("brier_sum", 6).alias("brier_sum"),
    )


def cohen_kappa(pairs: DataFrame, keys: list[str], a: str, b: str, weighted: bool = False) -> DataFrame:
    """keys, n, kappa of two raters; quadratic weights for ordinal scores.  Null where chance agreement is complete."""
    cells = pairs.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    d = (F.col(a) - F.col(b)) ** 2 if weighted else (F.col(a) != F.col(b)).cast("double")
    seen = cells.groupBy(*keys).agg(F.sum(d * F.col("n")).alias("seen"), F.sum("n").alias("n"))
    ma = cells.groupBy(*keys, a).agg(F.sum("n").alias("na"))
    mb = cells.groupBy(*keys, b).agg(F.sum("n").alias("nb"))
    grid = ma.join(mb, keys) if keys else ma.crossJoin(mb)
    chance = grid.groupBy(*keys).agg(F.sum(d * F.col("na") * F.col("nb")).alias("chance"))
    both = seen.join(chance, keys) if keys else seen.crossJoin(chance)
    return both.select(*keys, "n", F.round(1 - div(F.col("seen") * F.col("n"), F.col("chance"), None), 6).alias("kappa"))


def ordinal_agreement(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    mae = rows.agg(F.round(F.avg(F.abs(F.col(expected) - F.col(predicted))), 6).alias("mae"))
    return mae.crossJoin(cohen_kappa(rows, [], expected, predicted, weighted=True).withColumnRenamed("kappa", "quadratic_weighted_kappa"))


def fleiss_kappa(ratings: DataFrame, subject: str, rater: str, category: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n_subjects, kappa: subjects with two or more ratings, cut to the smallest number of raters."""
    keys = keys or []
    w = Window.partitionBy(*keys, subject).orderBy(rater)
    r = ratings.where(F.col(category).isNotNull()).withColumn("k", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy(*keys, subject))).where("m >= 2")
    least = F.min("m").over(Window.partitionBy(*keys)) if keys else F.min("m").over(Window.partitionBy(F.lit(1)))
    cut = r.withColumn("raters", least).where("k <= raters")
    cells = cut.groupBy(*keys, subject, category, "raters").agg(F.count("*").alias("n"))
    subj = cells.groupBy(*keys, subject, "raters").agg((F.sum(F.col("n") * F.col("n")) - F.first("raters")).alias("agree"))
    p = subj.groupBy(*keys, "raters").agg(F.count("*").alias("n_subjects"), F.avg(F.col("agree") / (F.col("raters") * (F.col("raters") - 1))).alias("p"))
    share = cells.groupBy(*keys, category).agg(F.sum("n").alias("nc"))
    tot = share.groupBy(*keys).agg((F.sum(F.col("nc") * F.col("nc")) / (F.sum("nc") * F.sum("nc"))).alias("pe"), F.count("*").alias("n_categories"))
    both = p.join(tot, keys) if keys else p.crossJoin(tot)
    kappa = F.when((F.col("n_categories") >= 2) & (F.col("pe") < 1), (F.col("p") - F.col("pe")) / (1 - F.col("pe")))
    return both.select(*keys, "n_subjects", F.round(kappa, 6).alias("kappa"))


def mcnemar(pairs: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """keys, b, c, p_value of the exact test; the tail is summed by ratios of neighbouring binomials."""
    counted = pairs.groupBy(*keys).agg(F.count_if(a & ~b).alias("b"), F.count_if(b & ~a).alias("c"))
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), k), start,
        lambda s, i: F.struct((s["log"] + F.log((n - i) / (i + 1.0))).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum")),
    )["sum"]
    return counted.select(*keys, "b", "c", F.when(n == 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), 2 * tail), 6)).alias("p_value"))
