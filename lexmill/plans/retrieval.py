"""Retrieval queries: documents ranked for the benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import text as X
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators.stages import sharing, stage
from ..session import stored

_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def bm25_sql(queries: str = "SELECT item_id AS q_id, text FROM benchmark") -> str:
    return f"""qs AS ({queries}), dt AS (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
 dl AS (SELECT doc_id, len({_TOK.format('text')}) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st), mi AS (SELECT avg(idf) AS m FROM idf0),
 idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM idf0, mi),
 qt AS (SELECT q_id, term, count(*) AS qtf FROM (SELECT q_id, unnest({_TOK.format('text')}) AS term FROM qs) GROUP BY ALL),
 sc AS (SELECT q_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS raw FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY q_id, doc_id),
 rk AS (SELECT q_id, doc_id, raw, CASE WHEN max(raw) OVER (PARTITION BY q_id) > 0 THEN raw / max(raw) OVER (PARTITION BY q_id) ELSE 0 END AS score, row_number() OVER (PARTITION BY q_id ORDER BY raw DESC, doc_id) AS rank FROM sc)"""


GOLD = "gold AS (SELECT b.item_id AS q_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_BUCKET = "('0x' || substr(md5(term), 1, 6))::BIGINT % 64"
DENSE = f"""dv0 AS (SELECT doc_id, {_BUCKET} AS bucket, count(*) AS n FROM dt GROUP BY ALL), dv AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM dv0),
 qv0 AS (SELECT q_id, {_BUCKET} AS bucket, sum(qtf) AS n FROM qt GROUP BY ALL), qv AS (SELECT q_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY q_id)) AS y FROM qv0),
 dn AS (SELECT q_id, doc_id, round(1 / (1 + greatest(2 - 2 * sum(x * y), 0.0)), 9) AS score FROM dv JOIN qv USING (bucket) GROUP BY ALL),
 dr AS (SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM dn)"""
_MULTI = """m AS (SELECT g.q_id, count(*) AS relevant, count(t.rank) AS hits, min(t.rank) AS best, sum(1 / log2(t.rank + 1)) AS dcg FROM gold g LEFT JOIN {top} t ON g.q_id = t.q_id AND g.doc_id = t.doc_id AND t.rank <= {k} GROUP BY g.q_id),
 z AS (SELECT q_id, count(*) AS size FROM {top} WHERE rank <= {k} GROUP BY q_id),
 pq AS (SELECT m.q_id, hits / relevant AS recall, hits / greatest(coalesce(size, 0), 1) AS precision, coalesce(1 / best, 0) AS rr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(relevant, {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, CASE WHEN best = 1 THEN 1.0 ELSE 0.0 END AS hit FROM m LEFT JOIN z USING (q_id))"""
_AVG = "round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit_at_1, count(*) AS n_examples"


def passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), "text")


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


#: Depth to which shared ranks go: the largest pool of a report's parts.
POOL = 200


def _inputs(sf_dir):
    return [f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet"]


def lexical(spark, sf_dir, k):
    rank = lambda n: R.bm25(passages(spark, sf_dir), texts(spark, sf_dir), n)
    if not sharing() or k > POOL:
        return rank(k)
    return stage("lexical", {"k": POOL}, _inputs(sf_dir), lambda: rank(POOL)).where(F.col("rank") <= k)


def gold(spark, sf_dir):
    return stage("gold", {}, _inputs(sf_dir), lambda: R.holding(passages(spark, sf_dir), texts(spark, sf_dir)))


def single_gold(spark, sf_dir):
    return gold(spark, sf_dir).groupBy("q_id").agg(F.min("doc_id").alias("doc_id"))


@query(f"WITH {bm25_sql()} SELECT q_id, doc_id, rank, round(score, 6) AS score FROM rk WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir, 10).select("q_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {GOLD} SELECT q_id, doc_id FROM gold")
def gold_passages(spark, sf_dir):
    return gold(spark, sf_dir)


@query(f"""WITH {bm25_sql()}, {GOLD}, g1 AS (SELECT q_id, min(doc_id) AS doc_id FROM gold GROUP BY q_id), z AS (SELECT q_id, count(*) AS size FROM rk WHERE rank <= 10 GROUP BY q_id),
 h AS (SELECT g1.q_id, rank, size FROM g1 LEFT JOIN rk ON g1.q_id = rk.q_id AND g1.doc_id = rk.doc_id AND rank <= 10 LEFT JOIN z ON g1.q_id = z.q_id)
SELECT round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 / size END), 6) AS precision, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr,
 round(avg(coalesce(1 / log2(rank + 1), 0)), 6) AS ndcg, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, count(*) AS n_examples FROM h""")
def bm25_retrieval_metrics(spark, sf_dir):
    return M.retrieval_single(lexical(spark, sf_dir, 10), single_gold(spark, sf_dir), 10)


@query(f"WITH {bm25_sql()}, {GOLD}, {_MULTI.format(top='rk', k=10)} SELECT {_AVG} FROM pq")
def multi_gold_retrieval_metrics(spark, sf_dir):
    return M.retrieval_multi(lexical(spark, sf_dir, 10), gold(spark, sf_dir), 10)


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, v.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("q_id"), "embedding")


_KNN = """knn AS (SELECT q.vec_id AS q_id, c.vec_id, c.label, q.label AS q_label, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS distance FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
 kr AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id) AS rank FROM knn)"""


@query(f"WITH {_KNN} SELECT q_id, vec_id, rank, round(1 / (1 + greatest(distance, 0)), 6) AS score FROM kr WHERE rank <= 10")
def dense_knn_topk(spark, sf_dir):
    return R.nearest(*_vectors(spark, sf_dir), 10).select("q_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_KNN}, e AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT round(avg(hits / n), 6) AS recall, round(avg(hits / 10), 6) AS precision, count(*) AS n_examples FROM (SELECT q_id, any_value(q_label) AS label, sum(CASE WHEN label = q_label THEN 1 ELSE 0 END) AS hits FROM kr WHERE rank <= 10 GROUP BY q_id) JOIN e USING (label)""")
def dense_label_recall(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    found = R.nearest(v, q, 10).select("q_id", F.col("vec_id").alias("doc_id"), "rank")
    of = v.select(F.col("vec_id").alias("q_id"), F.col("label").alias("want"))
    hit = found.join(v.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").join(of, "q_id")
    sizes = v.groupBy(F.col("label").alias("want")).agg(F.count("*").alias("n"))
    per = hit.groupBy("q_id", "want").agg(F.count_if(F.col("label") == F.col("want")).alias("hits")).join(sizes, "want")
    return per.agg(F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("recall"), F.round(F.avg(F.col("hits") / 10), 6).alias("precision"), F.count("*").alias("n_examples"))


def hybrid(spark, sf_dir, k):
    pool = max(10 * k, 200)
    return R.fuse(lexical(spark, sf_dir, pool), R.hashed_dense(passages(spark, sf_dir), texts(spark, sf_dir), pool), k)


_HYBRID = f"""WITH {bm25_sql()}, {DENSE}, hy AS (SELECT coalesce(a.q_id, b.q_id) AS q_id, coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(5.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS fused
 FROM (SELECT * FROM rk WHERE rank <= 200) a FULL JOIN (SELECT * FROM dr WHERE rank <= 200) b ON a.q_id = b.q_id AND a.doc_id = b.doc_id),
 hr AS (SELECT q_id, doc_id, fused, row_number() OVER (PARTITION BY q_id ORDER BY fused DESC, doc_id) AS rank FROM hy)"""


@query(f"{_HYBRID} SELECT q_id, doc_id, round(fused, 6) AS fused, rank FROM hr WHERE rank <= 10")
def hybrid_rrf(spark, sf_dir):
    return hybrid(spark, sf_dir, 10).select("q_id", "doc_id", F.round("fused", 6).alias("fused"), "rank")


@query(f"{_HYBRID}, {GOLD}, {_MULTI.format(top='hr', k=10)} SELECT {_AVG} FROM pq")
def hybrid_retrieval_metrics(spark, sf_dir):
    return M.retrieval_multi(hybrid(spark, sf_dir, 10), gold(spark, sf_dir), 10)


def with_overlap(candidates, asked, documents):
    """The candidates with s, the cross-encoder's stand-in: the share of the query's distinct tokens that stand in the document.

    Each text that is a candidate is cut into its set of token hashes once, where it stands; only the sets move.
    """
    candidates = stored(candidates, "candidates")  # so that their size is known
    documents = documents.join(candidates.select("doc_id"), "doc_id", "left_semi")
    held = lambda key, name, t: t.select(key, F.array_distinct(F.transform(X.tokens("text"), lambda x: F.xxhash64(x))).alias(name))
    both = candidates.join(held("doc_id", "in_text", documents), "doc_id").join(held("q_id", "in_query", asked), "q_id")
    return both.withColumn("s", F.round(F.try_divide(F.size(F.array_intersect("in_query", "in_text")), F.size("in_query")), 9)).drop("in_text", "in_query")


def reranked(spark, sf_dir, pool, j, least=None):
    cand = lexical(spark, sf_dir, pool).select("q_id", "doc_id", "rank")
    return R.rerank(with_overlap(cand, passages(spark, sf_dir), texts(spark, sf_dir)), F.col("s"), j, least)


_RERANK = f"""WITH {bm25_sql()}, {GOLD}, rs AS (SELECT r.q_id, r.doc_id, r.rank, round(len(list_intersect({_TOK.format('b.text')}, {_TOK.format('d.text')})) / len(list_distinct({_TOK.format('b.text')})), 9) AS s FROM rk r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = r.q_id WHERE r.rank <= 50),
 nr AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, rank) AS new_rank FROM rs WHERE s >= 0.1)"""


@query(f"{_RERANK} SELECT q_id, doc_id, rank AS old_rank, new_rank, round(s, 6) AS score FROM nr WHERE new_rank <= 15")
def rerank_topj(spark, sf_dir):
    return reranked(spark, sf_dir, 50, 15, 0.1).select("q_id", "doc_id", F.col("rank").alias("old_rank"), "new_rank", F.round("rerank_score", 6).alias("score"))


@query(f"""{_RERANK}, j AS (SELECT unnest([1, 5, 8, 15, 30, 50])::BIGINT AS j), g AS (SELECT gold.q_id, gold.doc_id, rank, new_rank FROM gold LEFT JOIN nr USING (q_id, doc_id))
SELECT j, round(avg(CASE WHEN rank <= j THEN 1.0 ELSE 0.0 END), 6) AS recall_before, round(avg(CASE WHEN new_rank <= j THEN 1.0 ELSE 0.0 END), 6) AS recall_after, count(*) AS n FROM g, j GROUP BY j""")
def rerank_recall_grid(spark, sf_dir):
    moved = gold(spark, sf_dir).join(reranked(spark, sf_dir, 50, 50, 0.1), ["q_id", "doc_id"], "left")
    js = spark.createDataFrame([(j,) for j in (1, 5, 8, 15, 30, 50)], "j bigint")
    share = lambda c: F.round(F.avg(F.when(F.col(c) <= F.col("j"), 1.0).otherwise(0.0)), 6)
    return moved.crossJoin(F.broadcast(js)).groupBy("j").agg(share("rank").alias("recall_before"), share("new_rank").alias("recall_after"), F.count("*").alias("n"))


@query(f"""{_RERANK} SELECT count(*) AS n_found, count(*) FILTER (WHERE new_rank > rank) AS demoted, count(*) FILTER (WHERE new_rank < rank) AS promoted, count(*) FILTER (WHERE new_rank = rank) AS unchanged,
 round(avg(new_rank - rank), 6) AS mean_delta FROM gold JOIN nr USING (q_id, doc_id)""")
def rank_movement(spark, sf_dir):
    m = gold(spark, sf_dir).join(reranked(spark, sf_dir, 50, 50, 0.1), ["q_id", "doc_id"]).withColumn("delta", F.col("new_rank") - F.col("rank"))
    return m.agg(F.count("*").alias("n_found"), F.count_if(F.col("delta") > 0).alias("demoted"), F.count_if(F.col("delta") < 0).alias("promoted"), F.count_if(F.col("delta") == 0).alias("unchanged"), F.round(F.avg("delta"), 6).alias("mean_delta"))


@query(f"""WITH {bm25_sql()}, {GOLD}, grid AS (SELECT k, j FROM (SELECT unnest([5, 10, 20]) AS k), (SELECT unnest([1, 5, 10, 15]) AS j) WHERE j <= k),
 g AS (SELECT gold.q_id, gold.doc_id, rank FROM gold LEFT JOIN rk USING (q_id, doc_id)),
 t AS (SELECT k, j, round(avg(CASE WHEN rank <= j THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN rank <= j THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr FROM g, grid GROUP BY k, j)
SELECT k::BIGINT AS top_k, j::BIGINT AS top_j, recall, mrr FROM t ORDER BY recall DESC, mrr DESC, j, k LIMIT 1""")
def tuning_grid_argmax(spark, sf_dir):
    grid = spark.createDataFrame([(k, j) for k in (5, 10, 20) for j in (1, 5, 10, 15) if j <= k], "top_k bigint, top_j bigint")
    g = gold(spark, sf_dir).join(lexical(spark, sf_dir, 20).select("q_id", "doc_id", "rank"), ["q_id", "doc_id"], "left")
    cell = lambda v: F.round(F.avg(F.when(F.col("rank") <= F.col("top_j"), v).otherwise(0.0)), 6)
    trials = g.crossJoin(F.broadcast(grid)).groupBy("top_k", "top_j").agg(cell(F.lit(1.0)).alias("recall"), cell(1.0 / F.col("rank")).alias("mrr"))
    best = trials.agg(F.max(F.struct("recall", "mrr", (-F.col("top_j")).alias("j"), (-F.col("top_k")).alias("k"))).alias("b"))
    return best.select((-F.col("b.k")).alias("top_k"), (-F.col("b.j")).alias("top_j"), "b.recall", "b.mrr")


_MODES = """SELECT item_id * 10 AS q_id, text FROM benchmark UNION ALL SELECT item_id * 10 + 1, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:12], ' ') FROM benchmark
 UNION ALL SELECT item_id * 10 + 2, 'Original clause: ' || text || chr(10) || 'Simplified clause: ' || array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:12], ' ') FROM benchmark"""


@query(f"""WITH {bm25_sql(_MODES)}, {GOLD}, g AS (SELECT gold.q_id, m, gold.doc_id, rank FROM gold CROSS JOIN (SELECT unnest([0, 1, 2]) AS m) LEFT JOIN rk ON rk.q_id = gold.q_id * 10 + m AND rk.doc_id = gold.doc_id)
SELECT CASE m WHEN 0 THEN 'original' WHEN 1 THEN 'simplified' ELSE 'combined' END AS query_mode, round(avg(CASE WHEN rank <= 8 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_8, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM g GROUP BY m""")
def query_mode_ablation(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    short = X.first_words("text", 12)
    modes = [("original", F.col("text")), ("simplified", short), ("combined", F.concat(F.lit("Original clause: "), "text", F.lit("\nSimplified clause: "), short))]
    asked = b.select("item_id", F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.lit(n).alias("mode"), t.alias("text")) for i, (n, t) in enumerate(modes)))).alias("x"))
    asked = asked.select((F.col("item_id") * 10 + F.col("x.m")).alias("q_id"), "item_id", F.col("x.mode").alias("query_mode"), "x.text")
    g = stored(gold(spark, sf_dir).withColumnRenamed("q_id", "item_id").join(asked.select("q_id", "item_id", "query_mode"), "item_id"), "gold-modes")
    g = g.join(R.bm25_ranks(asked.select("q_id", "text"), texts(spark, sf_dir), g.select("q_id", "doc_id")), ["q_id", "doc_id"], "left")
    return g.groupBy("query_mode").agg(F.round(F.avg(F.when(F.col("rank") <= 8, 1.0).otherwise(0.0)), 6).alias("recall_at_8"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


@query(f"""WITH {bm25_sql()}, {GOLD}, g1 AS (SELECT q_id, min(doc_id) AS doc_id FROM gold GROUP BY q_id), t AS (SELECT q.q_id, r.doc_id AS predicted, g1.doc_id AS expected FROM qs q LEFT JOIN (SELECT * FROM rk WHERE rank = 1 AND score * raw > 40) r ON q.q_id = r.q_id LEFT JOIN g1 ON q.q_id = g1.q_id)
SELECT round(avg(CASE WHEN predicted = expected THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN predicted IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS n_examples FROM t WHERE expected IS NOT NULL""")
def attribution_accuracy(spark, sf_dir):
    first = lexical(spark, sf_dir, 1).where(F.col("score") * F.col("raw") > 40).select("q_id", F.col("doc_id").alias("predicted"))
    rows = passages(spark, sf_dir).select("q_id").join(first, "q_id", "left").join(single_gold(spark, sf_dir).withColumnRenamed("doc_id", "expected"), "q_id", "left")
    return M.attribution(rows, "predicted", "expected")


@query(f"""WITH {bm25_sql()}, {GOLD}, g1 AS (SELECT q_id, min(doc_id) AS doc_id FROM gold GROUP BY q_id)
SELECT count(g1.doc_id) AS n_with_gold, CASE WHEN count(g1.doc_id) = 0 THEN 'blocked' ELSE 'measured' END AS status, round(avg(CASE WHEN g1.doc_id IS NULL THEN NULL WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5
 FROM qs LEFT JOIN g1 USING (q_id) LEFT JOIN rk ON rk.q_id = qs.q_id AND rk.doc_id = g1.doc_id""")
def independent_recall(spark, sf_dir):
    hits = lexical(spark, sf_dir, 5).groupBy("q_id").agg(F.collect_list("doc_id").alias("found"))  # five ids a query
    rows = passages(spark, sf_dir).select("q_id").join(single_gold(spark, sf_dir), "q_id", "left").join(hits, "q_id", "left")
    hit = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.array_contains("found", F.col("doc_id")), F.lit(False)).cast("double"))
    return rows.agg(F.count("doc_id").alias("n_with_gold"), F.when(F.count("doc_id") == 0, "blocked").otherwise("measured").alias("status"), F.round(F.avg(hit), 6).alias("recall_at_5"))
