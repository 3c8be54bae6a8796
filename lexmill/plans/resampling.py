"""Bootstrap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, table
from ..operators import resample as S
from .evaluation import BASE, labelled

SAMPLES, SEED = 200, 42


def _draw_sql(rows: str, samples: int = SAMPLES) -> str:
    step = "(({y}) * ({y}) + x + {c}) % 2147483647"
    return f"""n AS (SELECT count(*) AS n FROM {rows}), d0 AS (SELECT s AS sample, n, ({SEED} * 7919 + s * 104729 + t * 1299709) % 2147483647 AS x FROM n, range({samples}) AS a(s), range((SELECT n FROM n)) AS b(t)),
 d1 AS (SELECT *, {step.format(y='x', c=12345)} AS y1 FROM d0), d2 AS (SELECT *, {step.format(y='y1', c=67890)} AS y2 FROM d1), dr AS (SELECT sample, {step.format(y='y2', c=424243)} % n AS idx FROM d2)"""


_CI = "round(quantile_cont({0}, 0.025), 6) AS {0}_lower, round(quantile_cont({0}, 0.975), 6) AS {0}_upper"
_PR = "coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0.0) AS precision, coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0.0) AS recall"


@query(f"""WITH v AS (SELECT user_id, avg(value) AS v, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM events GROUP BY user_id), {_draw_sql('v')},
 m AS (SELECT sample, avg(v) AS mean FROM dr JOIN v USING (idx) GROUP BY sample) SELECT {_CI.format('mean')}, (SELECT round(avg(v), 6) FROM v) AS mean, (SELECT n FROM n) AS n FROM m""")
def bootstrap_mean_ci(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    return S.mean_ci(v, "v", ["user_id"], SAMPLES, SEED)


@query(f"""WITH {BASE}, v AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, (quality = 1 AND s1 >= 0.376)::INT AS tp, (quality = 0 AND s1 >= 0.376)::INT AS fp, (quality = 1 AND s1 < 0.376)::INT AS fn FROM base),
 {_draw_sql('v')}, m AS (SELECT sample, {_PR} FROM dr JOIN v USING (idx) GROUP BY sample) SELECT {_CI.format('precision')}, {_CI.format('recall')} FROM m""")
def bootstrap_pr_ci(spark, sf_dir):
    return S.precision_recall_ci(labelled(spark, sf_dir), "quality", "s1", 0.376, ["doc_id"], SAMPLES, SEED)


@query(f"""WITH {BASE}, v AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx, count(*) FILTER (WHERE quality = 1 AND s1 >= 0.376) AS tp, count(*) FILTER (WHERE quality = 0 AND s1 >= 0.376) AS fp,
 count(*) FILTER (WHERE quality = 1 AND s1 < 0.376) AS fn FROM base GROUP BY source), {_draw_sql('v')}, m AS (SELECT sample, {_PR} FROM dr JOIN v USING (idx) GROUP BY sample)
SELECT {_CI.format('precision')}, {_CI.format('recall')}, (SELECT n FROM n) AS n_groups FROM m""")
def bootstrap_clustered_ci(spark, sf_dir):
    return S.precision_recall_ci_clustered(labelled(spark, sf_dir), "quality", "s1", 0.376, "source", SAMPLES, SEED)


@query(f"""WITH {BASE}, v AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, s1 - s3 AS diff FROM base), {_draw_sql('v')}, m AS (SELECT sample, round(avg(diff), 12) AS difference FROM dr JOIN v USING (idx) GROUP BY sample)
SELECT {_CI.format('difference')}, round(least(1.0, 2 * least(avg((difference <= 0)::INT), avg((difference >= 0)::INT))), 6) AS p_two_sided, (SELECT round(avg(diff), 6) FROM v) AS mean_difference, (SELECT n FROM n) AS n FROM m""")
def paired_bootstrap(spark, sf_dir):
    return S.paired_difference(labelled(spark, sf_dir), "s1", "s3", ["doc_id"], SAMPLES, SEED)


@query()
def bootstrap_exact_rng(spark, sf_dir):
    return S.exact_rng_ci(labelled(spark, sf_dir).select("lang", "s1"), ["lang"], "s1", 200, SEED)


@query()
def bootstrap_poisson(spark, sf_dir):
    return S.poisson_mean(table(spark, sf_dir, "events"), "value", "event_id", 50, SEED)
