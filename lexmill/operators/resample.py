"""Bootstrap intervals.

Draws come from integer arithmetic that any engine reproduces: x = seed * 7919 +
sample * 104729 + slot * 1299709 mod P is squared and shifted three times, mod P =
2147483647, and taken mod n (x itself would give arithmetic progressions).  Samples and
slots are a range, so drawing is spread over all tasks; the joins are equi-joins on the
drawn index.  It is meant for evaluation sets; ``poisson_mean`` serves sets too large to
draw from, with one pass and no join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship, stored
from .metrics import div


P, SHIFTS = 2147483647, (12345, 67890, 424243)


def draws(spark: SparkSession, n: int, samples: int, seed: int) -> DataFrame:
    """sample, idx: n draws with replacement from 0..n-1 for each sample."""
    r = spark.range(samples * n) if n else spark.range(0)
    sample, slot = F.expr(f"id div {max(n, 1)}"), F.col("id") % max(n, 1)
    mixed = r.select(sample.alias("sample"), ((seed * 7919 + sample * 104729 + slot * 1299709) % P).alias("x")).withColumn("y", F.col("x"))
    for shift in SHIFTS:
        mixed = mixed.withColumn("y", (F.col("y") * F.col("y") + F.col("x") + shift) % P)
    return mixed.select("sample", (F.col("y") % max(n, 1)).alias("idx"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, the rows' places in ``order`` from 0: places in sorted ranges, plus the sizes of the ranges before."""
    at = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranges.withColumns({"__range": F.shiftright(at, 33), "__place": at.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))  # a row a range
    return placed.join(F.broadcast(offsets), "__range").withColumn("idx", F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")


def interval(per_sample: DataFrame, columns: list[str], confidence: float = 0.95) -> DataFrame:
    """One row with <column>_lower and <column>_upper, interpolated percentiles."""
    a = (1 - confidence) / 2
    return per_sample.agg(*(F.round(F.percentile(c, F.lit(p)), 6).alias(f"{c}_{e}") for c in columns for p, e in ((a, "lower"), (1 - a, "upper"))))


def mean_ci(rows: DataFrame, value: str, order: list[str], samples: int = 1000, seed: int = 42) -> DataFrame:
    v = numbered(rows.select(*dict.fromkeys([*order, value])), order)
    drawn = draws(rows.sparkSession, rows.count(), samples, seed).join(v, "idx").groupBy("sample").agg(F.avg(value).alias("mean"))
    return interval(drawn, ["mean"]).crossJoin(rows.agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n")))


def _pr(rows: DataFrame, label: Column, predicted: Column, weight: Column) -> DataFrame:
    w = lambda c: F.sum(F.when(c, weight).otherwise(0))
    c = rows.groupBy("sample").agg(w((label == 1) & predicted).alias("tp"), w((label == 0) & predicted).alias("fp"), w((label == 1) & ~predicted).alias("fn"))
    return c.select("sample", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def precision_recall_ci(rows: DataFrame, label: str, score: str, tau: float, order: list[str], samples: int = 2000, seed: int = 42) -> DataFrame:
    v = numbered(rows.select(*dict.fromkeys([*order, label, score])), order)
    drawn = draws(rows.sparkSession, rows.count(), samples, seed).join(v, "idx")
    return interval(_pr(drawn, F.col(label), F.col(score) >= tau, F.lit(1)), ["precision", "recall"])


def precision_recall_ci_clustered(rows: DataFrame, label: str, score: str, tau: float, group: str, samples: int = 2000, seed: int = 42) -> DataFrame:
    """Whole groups are drawn; a group's counts stand for its records, so a large group costs one row.

    A blank group is an error.
    """
    bad = F.trim(F.coalesce(F.col(group).cast("string"), F.lit(""))) == ""
    checked = rows.withColumn(group, F.when(bad, F.raise_error(F.lit("a record has no group"))).otherwise(F.col(group)))
    pred = F.col(score) >= tau
    per = checked.groupBy(group).agg(F.count_if((F.col(label) == 1) & pred).alias("tp"), F.count_if((F.col(label) == 0) & pred).alias("fp"), F.count_if((F.col(label) == 1) & ~pred).alias("fn"))
    v = numbered(per, [group])
    n = per.count()
    c = draws(rows.sparkSession, n, samples, seed).join(v, "idx").groupBy("sample").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    pr = c.select("sample", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return interval(pr, ["precision", "recall"]).withColumn("n_groups", F.lit(n).cast("bigint"))


def paired_difference(rows: DataFrame, a: str, b: str, order: list[str], samples: int = 1000, seed: int = 42) -> DataFrame:
    """Mean of a - b, its interval, and the two-sided sign probability."""
    d = rows.withColumn("diff", F.col(a) - F.col(b))
    v = numbered(d.select(*dict.fromkeys([*order, "diff"])), order)
    n = rows.count()
    means = draws(rows.sparkSession, n, samples, seed).join(v, "idx").groupBy("sample").agg(F.round(F.avg("diff"), 12).alias("difference"))
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("difference") <= 0).cast("double")), F.avg((F.col("difference") >= 0).cast("double"))))
    both = means.agg(F.round(p, 6).alias("p_two_sided"))
    return interval(means, ["difference"]).crossJoin(both).crossJoin(d.agg(F.round(F.avg("diff"), 6).alias("mean_difference"), F.count("*").alias("n")))


def poisson_mean(rows: DataFrame, value: str, key: str, samples: int = 200, seed: int = 42) -> DataFrame:
    """Interval of a mean by Poisson weights: one pass, sums per sample, nothing drawn or joined."""
    u = lambda s: F.pmod(F.xxhash64(F.col(key), s, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    steps, total, p = [], 0.0, float(np.exp(-1))
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    weight = lambda s: sum((F.when(u(s) >= e, 1).otherwise(0) for e in steps), F.lit(0))
    spread = rows.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    w = spread.select("sample", (weight(F.col("sample")) * F.col(value)).alias("x"), weight(F.col("sample")).alias("w"))
    return interval(w.groupBy("sample").agg(div(F.sum("x"), F.sum("w")).alias("mean")), ["mean"])


def exact_rng_ci(rows: DataFrame, keys: list[str], value: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """keys, mean, lower, upper with numpy's generator and quantiles, one evaluation set per group."""
    ship(rows.sparkSession)

    def run(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        x = groups[value].to_numpy(float)
        rng = np.random.default_rng(seed)
        means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(samples)])
        return pd.DataFrame([[*(groups[k].iloc[0] for k in keys), x.mean(), np.quantile(means, 0.025), np.quantile(means, 0.975)]], columns=[*keys, "mean", "lower", "upper"])

    kinds = dict(rows.dtypes)
    return rows.select(*keys, value).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", mean double, lower double, upper double")
