"""Benchmark-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import text as X
from ..operators import benchmark as B
from ..operators import stress
from .text import documents

LABELS = ["en", "de", "fr", "es", "it"]
_SEED = "md5('42:' || doc_id)"
_KEY = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
_SPLIT = "CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END"
SPLITS = f"sp AS (SELECT doc_id, text, lang, source, {_SPLIT} AS split FROM (SELECT *, ('0x' || substr(sha256(source || ':' || doc_id), 1, 8))::BIGINT % 100 AS b FROM documents))"


def with_split(spark, sf_dir):
    return documents(spark, sf_dir).withColumn("split", X.hash_split(F.concat_ws(":", "source", "doc_id")))


def _plan(spark, sf_dir, total=250):
    return B.achievable(B.balanced_quotas(B.supply(documents(spark, sf_dir), LABELS, "lang"), total, len(LABELS)), 3, 5)


_PLAN = """sup AS (SELECT o AS ordinal, l AS label, (SELECT count(*) FROM documents WHERE lang = l) AS available FROM (VALUES (0, 'en'), (1, 'de'), (2, 'fr'), (3, 'es'), (4, 'it')) AS v(o, l)),
 pl AS (SELECT ordinal::BIGINT AS ordinal, label, available, 50::BIGINT AS required, least(50, available // 3) AS quota, greatest(50 - available, 0) AS shortage,
  CASE WHEN least(50, available // 3) < 5 THEN 'infeasible' WHEN least(50, available // 3) < 50 THEN 'limited' ELSE 'full' END AS status FROM sup)"""


@query(f"WITH {_PLAN} SELECT ordinal, label, available, required, quota, shortage, status FROM pl")
def supply_audit(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"WITH {_PLAN}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pool_rank FROM documents WHERE n_chars >= 40) SELECT doc_id, r.lang, pool_rank FROM r JOIN pl ON pl.label = r.lang WHERE pool_rank <= quota")
def balanced_quota_pool(spark, sf_dir):
    d = documents(spark, sf_dir).where("n_chars >= 40").select("doc_id", "lang")
    return B.quota_pool(d, _plan(spark, sf_dir), "lang", ["doc_id"])


def variants(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "lang", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(3)))).alias("variant"))
    i, v = F.col("doc_id"), F.col("variant")
    return d.select(
        "doc_id", "lang", "variant", ((i * 31 + v * 17) % 7 != 0).alias("faithful"), ((i * 13 + v * 7) % 5 + 1).alias("semantic"), ((i * 7 + v * 11) % 5 + 1).alias("readability"),
        ((i * 37 + v * 53) % 100).cast("double").alias("sari"), (0.8 + (i * 3 + v * 5) % 20 / 100.0).alias("bertscore"), ((i * 17 + v * 29) % 14).cast("double").alias("fk"),
    )


_VAR = """va AS (SELECT doc_id, lang, v AS variant, (doc_id * 31 + v * 17) % 7 <> 0 AS faithful, (doc_id * 13 + v * 7) % 5 + 1 AS semantic, (doc_id * 7 + v * 11) % 5 + 1 AS readability,
 ((doc_id * 37 + v * 53) % 100)::DOUBLE AS sari, 0.8::DOUBLE + (doc_id * 3 + v * 5) % 20 / 100.0::DOUBLE AS bertscore, ((doc_id * 17 + v * 29) % 14)::DOUBLE AS fk FROM documents, range(3) AS r(v))"""
_REASONS = "list_filter([CASE WHEN NOT faithful THEN 'not faithful' END, CASE WHEN semantic < 4 THEN 'semantic below 4' END, CASE WHEN readability < 4 THEN 'readability below 4' END, CASE WHEN sari < 40 THEN 'sari below 40' END, CASE WHEN bertscore < 0.88 THEN 'bertscore below 0.88' END, CASE WHEN fk > 9 THEN 'grade above 9' END], lambda x: x IS NOT NULL)"


@query(f"WITH {_VAR} SELECT doc_id, variant, len({_REASONS}) = 0 AS passed, array_to_string({_REASONS}, '; ') AS reasons FROM va")
def quality_gate_reasons(spark, sf_dir):
    r = B.gate_reasons()
    return variants(spark, sf_dir).select("doc_id", "variant", (F.size(r) == 0).alias("passed"), F.array_join(r, "; ").alias("reasons"))


@query(f"WITH {_VAR} SELECT lang, reason, count(*) AS n FROM (SELECT lang, unnest({_REASONS}) AS reason FROM va) GROUP BY ALL")
def rejection_histogram(spark, sf_dir):
    return variants(spark, sf_dir).select("lang", F.explode(F.array_distinct(B.gate_reasons())).alias("reason")).groupBy("lang", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {_VAR} SELECT doc_id, variant, sari FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY semantic DESC, readability DESC, bertscore DESC, sari DESC, fk, variant) AS rn FROM va) WHERE rn = 1")
def best_variant(spark, sf_dir):
    v = variants(spark, sf_dir)
    key = F.struct("semantic", "readability", "bertscore", "sari", -F.col("fk"), -F.col("variant"))
    return v.groupBy("doc_id").agg(F.max_by(F.struct("variant", "sari"), key).alias("b")).select("doc_id", "b.*")


@query(f"""WITH {_VAR} SELECT doc_id, variant, status FROM (SELECT doc_id, variant, CASE WHEN faithful THEN 'accepted' ELSE 'needs_review' END AS status,
 row_number() OVER (PARTITION BY doc_id ORDER BY faithful DESC, CASE WHEN faithful THEN fk ELSE -semantic END, CASE WHEN faithful THEN -semantic ELSE fk END, variant) AS rn FROM va) WHERE rn = 1""")
def best_rewrite(spark, sf_dir):
    v = variants(spark, sf_dir).withColumn("a", F.when(F.col("faithful"), F.col("fk")).otherwise(-F.col("semantic"))).withColumn("b", F.when(F.col("faithful"), -F.col("semantic")).otherwise(F.col("fk")))
    best = v.groupBy("doc_id").agg(F.min_by(F.struct("variant", "faithful"), F.struct(~F.col("faithful"), "a", "b", "variant")).alias("x"))
    return best.select("doc_id", "x.variant", F.when(F.col("x.faithful"), "accepted").otherwise("needs_review").alias("status"))


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' ELSE 'contradiction' END AS label FROM conversations),
 p AS (SELECT conv_id, max(turn) FILTER (WHERE label = 'entailment') AS s, max(turn) FILTER (WHERE label = 'neutral') AS n, max(turn) FILTER (WHERE label = 'contradiction') AS c FROM c GROUP BY conv_id HAVING count(*) > 1),
 r AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS i FROM p)
SELECT conv_id || '::supported' AS record_id, conv_id, 1::BIGINT AS supported, s AS chosen FROM r UNION ALL SELECT conv_id || '::unsupported', conv_id, 0, CASE WHEN i % 2 = 0 THEN coalesce(n, c) ELSE coalesce(c, n) END FROM r""")
def companion_records(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    kind = F.when(F.col("turn") % 3 == 0, "entailment").when(F.col("turn") % 3 == 1, "neutral").otherwise("contradiction")
    many = t.groupBy("conv_id").count().where("count > 1").select("conv_id")
    return B.companions(t.withColumn("label", kind).join(many, "conv_id", "left_semi"), "conv_id", "label", "turn", "turn")


@query(f"SELECT doc_id, turn FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {_SEED}) AS turn FROM documents) ORDER BY turn, lang, source LIMIT 50")
def stratified_round_robin(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "lang", "source")
    return B.round_robin(d, ["lang", "source"], [B.seeded(42, "doc_id")], 50).select("doc_id", "turn")


@query(f"""WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_SEED}) <= least(25, greatest(1, count(*) OVER (PARTITION BY lang) // 10)) AS v FROM documents),
 t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM h WHERE NOT v), m AS (SELECT max(n) AS m FROM t)
SELECT doc_id, lang, (m - r - 1) // n + 1 AS copies FROM t, m""")
def stratified_holdout_oversample(spark, sf_dir):
    train = B.holdout(documents(spark, sf_dir).select("doc_id", "lang"), "lang", [B.seeded(42, "doc_id")]).where("part = 'train'")
    return B.oversample(train.select("doc_id", "lang"), "lang", ["doc_id"]).groupBy("doc_id", "lang").agg(F.count("*").alias("copies"))


@query(f"WITH {SPLITS} SELECT doc_id FROM sp WHERE split = 'validation' AND {_KEY} NOT IN (SELECT {_KEY} FROM sp WHERE split = 'train')")
def validation_antijoin(spark, sf_dir):
    s = with_split(spark, sf_dir)
    key = F.lower(X.normalise("text"))
    return B.without_contamination(s.where("split = 'validation'"), s.where("split = 'train'"), key).select("doc_id")


@query(f"""WITH {SPLITS}, k AS (SELECT DISTINCT split, sha256(lang || chr(0) || text) AS k FROM sp), n AS (SELECT * FROM (VALUES ('test', 'train'), ('test', 'validation'), ('train', 'validation')) AS v(split_a, split_b))
SELECT split_a, split_b, (SELECT count(*) FROM k a JOIN k b ON a.k = b.k WHERE a.split = split_a AND b.split = split_b) AS shared FROM n""")
def leakage_overlap(spark, sf_dir):
    return B.split_overlap(with_split(spark, sf_dir), "split", F.sha2(F.concat("lang", F.lit("\0"), "text"), 256))


@query(r"""WITH s AS (SELECT 'doc:' || doc_id AS source_id, 'documents' AS origin, text FROM documents UNION ALL SELECT 'conv:' || conv_id || ':' || turn, 'conversations', text FROM conversations UNION ALL SELECT 'bench:' || item_id, 'benchmark', text FROM benchmark),
 c AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY md5('42:' || source_id)) AS rn FROM s), k AS (SELECT * FROM c WHERE rn <= CASE origin WHEN 'documents' THEN 100 WHEN 'conversations' THEN 30 ELSE 15 END)
SELECT source_id, origin, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:40], ' ') AS text FROM k ORDER BY md5('42:' || source_id) LIMIT 100""")
def mixed_source_interleave(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.concat(F.lit("doc:"), "doc_id").alias("source_id"), F.lit("documents").alias("origin"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv:"), "conv_id", F.lit(":"), "turn").alias("source_id"), F.lit("conversations").alias("origin"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench:"), "item_id").alias("source_id"), F.lit("benchmark").alias("origin"), "text")
    parts = [x.orderBy(B.seeded(42, "source_id")).limit(n) for x, n in ((d, 100), (c, 30), (b, 15))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).dropDuplicates(["source_id"])
    return every.orderBy(B.seeded(42, "source_id")).limit(100).select("source_id", "origin", X.first_words("text", 40).alias("text"))


@query("""SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.n_chars > 600 THEN 1 ELSE 0 END)::BIGINT AS supported, coalesce(l.toxic, 0)::BIGINT AS flagged, l.doc_id IS NOT NULL AS reviewed FROM documents d LEFT JOIN labels l USING (doc_id)""")
def adjudication_overlay(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.when(F.col("n_chars") > 600, 1).otherwise(0).cast("bigint").alias("supported"), F.lit(0).cast("bigint").alias("flagged"))
    r = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("supported"), F.col("toxic").cast("bigint").alias("flagged"))
    return B.overlay(d, r, "doc_id", ["supported", "flagged"])


@query("""WITH k AS (SELECT conv_id, turn, sha256('rewrite' || chr(0) || 'stub' || chr(0) || text) AS cache_key FROM conversations), cached AS (SELECT DISTINCT cache_key FROM k WHERE turn % 2 = 0)
SELECT min(conv_id * 1000 + turn) AS first_use, cache_key, count(*) AS uses FROM k WHERE cache_key NOT IN (SELECT cache_key FROM cached) GROUP BY cache_key""")
def response_cache_antijoin(spark, sf_dir):
    key = F.sha2(F.concat_ws("\0", F.lit("rewrite"), F.lit("stub"), "text"), 256)
    k = table(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("cache_key"))
    cached = k.where("turn % 2 = 0").select("cache_key").distinct()
    return k.join(cached, "cache_key", "left_anti").groupBy("cache_key").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_use"), F.count("*").alias("uses"))


@query("WITH f AS (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY min(length(text)), conv_id LIMIT 20) SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM f)")
def limit_unique_clauses(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("len", F.length("text"))
    return B.limit_unique(t, "conv_id", ["len", "conv_id"], 20).select("conv_id", "turn")


@query("""WITH b AS (SELECT source, substr(h, 1, 3) AS bucket, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS k, sum(n) AS n FROM (SELECT source, sha256(text) AS h, length(text) AS n FROM documents) GROUP BY ALL),
 d AS (SELECT source, sha256(string_agg(d, chr(10) ORDER BY bucket)) AS source_hash, sum(k)::BIGINT AS n_docs, sum(n)::BIGINT AS n_chars FROM b GROUP BY source)
SELECT source, n_docs, n_chars, source_hash, (SELECT sha256(string_agg(source_hash, chr(10) ORDER BY source_hash)) FROM d) AS corpus_hash FROM d""")
def corpus_manifest_hash(spark, sf_dir):
    """A tree of digests: of a source's texts in each of 4096 buckets, of its buckets, of all sources."""
    h = documents(spark, sf_dir).select("source", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n"), 256)
    buckets = h.groupBy("source", F.substring("h", 1, 3).alias("bucket")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), joined("h").alias("d"))
    in_order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), "\n")  # 4096 at most
    per = buckets.groupBy("source").agg(F.sum("k").alias("n_docs"), F.sum("n").alias("n_chars"), F.sha2(in_order, 256).alias("source_hash"))
    return per.crossJoin(per.agg(joined("source_hash").alias("corpus_hash")))


@query("""WITH r AS (SELECT doc_id AS run_id, 'cfg' || (doc_id % 40) AS name, substr(sha256('cfg' || (doc_id % 37)), 1, 16) AS fp FROM documents)
SELECT 'fingerprint' AS rule, fp AS value, count(DISTINCT name) AS n FROM r GROUP BY fp HAVING count(DISTINCT name) > 1 UNION ALL SELECT 'name', name, count(DISTINCT fp) FROM r GROUP BY name HAVING count(DISTINCT fp) > 1""")
def provenance_registry_checks(spark, sf_dir):
    r = documents(spark, sf_dir).select(F.concat(F.lit("cfg"), F.col("doc_id") % 40).alias("name"), X.sha_prefix(F.concat(F.lit("cfg"), F.col("doc_id") % 37), 16).alias("fp"))
    one = lambda rule, k, v: r.groupBy(F.col(k).alias("value")).agg(F.count_distinct(v).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "value", "n")
    return one("fingerprint", "fp", "name").unionByName(one("name", "name", "fp"))


@query("""WITH t AS (SELECT * FROM (VALUES ('1 urgent', 'Penalty Clause'), ('2 high', 'Hidden Fee'), ('3 medium', 'Data Sharing')) AS v(k, target))
SELECT o_orderpriority AS source_label, target, count(*) AS n FROM orders LEFT JOIN t ON trim(regexp_replace(replace(lower(o_orderpriority), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) = t.k GROUP BY ALL""")
def taxonomy_lookup(spark, sf_dir):
    t = spark.createDataFrame([("1-URGENT", "Penalty Clause"), ("2 High", "Hidden Fee"), ("3_medium", "Data Sharing")], "source string, target string").select(X.label_key("source").alias("k"), "target")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source_label"), X.label_key("o_orderpriority").alias("k"))
    return o.join(F.broadcast(t), "k", "left").groupBy("source_label", "target").agg(F.count("*").alias("n"))


_W = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"


@query(f"""SELECT source, count(*) AS n, count(DISTINCT text) AS n_distinct, round(avg(w), 6) AS mean_words, median(w)::DOUBLE AS median_words, round(quantile_cont(w, 0.95), 6) AS p95_words, min(w)::BIGINT AS min_words, max(w)::BIGINT AS max_words FROM (SELECT source, text, {_W} AS w FROM documents) GROUP BY source""")
def eda_profile(spark, sf_dir):
    d = documents(spark, sf_dir).select("source", F.sha2("text", 256).alias("h"), X.word_count("text").cast("bigint").alias("w"))
    return d.groupBy("source").agg(
        F.count("*").alias("n"), F.count_distinct("h").alias("n_distinct"), F.round(F.avg("w"), 6).alias("mean_words"), F.percentile("w", F.lit(0.5)).alias("median_words"),
        F.round(F.percentile("w", F.lit(0.95)), 6).alias("p95_words"), F.min("w").alias("min_words"), F.max("w").alias("max_words"),
    )


@query("SELECT term, n FROM (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term) ORDER BY n DESC, term LIMIT 20")
def eda_top_terms(spark, sf_dir):
    t = documents(spark, sf_dir).select(F.explode(X.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "term").limit(20)


@query("""SELECT coalesce(o_orderstatus, '') AS status, coalesce(o_orderpriority, '') AS priority, coalesce(l_returnflag, '') AS flag, count(*) AS n, round(avg(l_quantity), 4) AS mean_quantity, round(avg(l_discount), 6) AS mean_discount
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (l_returnflag))""")
def grouping_sets_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_discount")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    g = j.groupingSets([["o_orderstatus"], ["o_orderpriority"], ["l_returnflag"]], "o_orderstatus", "o_orderpriority", "l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"), F.round(F.avg("l_discount"), 6).alias("mean_discount")
    )
    name = lambda c: F.coalesce(c, F.lit(""))
    return g.select(name("o_orderstatus").alias("status"), name("o_orderpriority").alias("priority"), name("l_returnflag").alias("flag"), "n", "mean_quantity", "mean_discount")


@query(r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents),
 c AS (SELECT doc_id, 'baseline_clean' AS condition, text AS t FROM w UNION ALL SELECT doc_id, 'technical_derivative_language', 'For the avoidance of doubt and subject to all applicable provisos, carve-outs, schedules, and cross-referenced definitions, ' || text FROM w
  UNION ALL SELECT doc_id, 'very_short_or_truncated', array_to_string(w[1:30], ' ') FROM w UNION ALL SELECT doc_id, 'unseen_jurisdiction', 'Under the law of an unspecified foreign jurisdiction, ' || text FROM w
  UNION ALL SELECT doc_id, 'cross_clause_dependency', 'Subject to Clause 14.3 and the exceptions in Schedule B, ' || text FROM w),
 m AS (SELECT condition, count(*) AS n, avg(length(t)) AS mean_chars FROM c GROUP BY condition)
SELECT condition, n, round(mean_chars, 4) AS mean_chars, round(mean_chars - (SELECT mean_chars FROM m WHERE condition = 'baseline_clean'), 4) AS delta FROM m""")
def stress_conditions(spark, sf_dir):
    names = ["baseline_clean", "technical_derivative_language", "very_short_or_truncated", "unseen_jurisdiction", "cross_clause_dependency"]
    c = stress.under_conditions(documents(spark, sf_dir), ["doc_id"], "text", names)
    m = c.groupBy("condition").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean"))
    base = m.where("condition = 'baseline_clean'").select(F.col("mean").alias("base"))
    return m.crossJoin(F.broadcast(base)).select("condition", "n", F.round("mean", 4).alias("mean_chars"), F.round(F.col("mean") - F.col("base"), 4).alias("delta"))


@query()
def stress_conditions_noisy(spark, sf_dir):
    from ..session import ship

    ship(spark)
    return stress.under_conditions(documents(spark, sf_dir), ["doc_id"], "text", ["scanned_ocr_noise_proxy", "reordered_clause_sentences"])


@query("SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def conversation_context(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    line = F.struct("turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("line"))
    return t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n\n").alias("context"))


_SHEET = """sheet AS (SELECT doc_id, quality AS r1, 1 - toxic AS r2, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 3 > 0)::INT END AS r3, CASE WHEN doc_id % 4 = 0 THEN quality END AS adjudicated FROM labels)"""


def review_sheet(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("r1"), (1 - F.col("toxic")).alias("r2"), F.when(i % 5 == 0, None).otherwise((i % 3 > 0).cast("int")).alias("r3"), F.when(i % 4 == 0, F.col("quality")).alias("adjudicated")
    )


@query(f"""WITH {_SHEET}, u AS (SELECT doc_id, r1 AS v FROM sheet UNION ALL SELECT doc_id, r2 FROM sheet UNION ALL SELECT doc_id, r3 FROM sheet), g AS (SELECT doc_id, count(v) AS n, count(DISTINCT v) AS d FROM u GROUP BY doc_id)
SELECT count(*) FILTER (WHERE n >= 2) AS double_reviewed, count(*) FILTER (WHERE n >= 2 AND d > 1) AS conflicts, (SELECT count(*) FROM sheet WHERE adjudicated IS NOT NULL) AS adjudicated, round((SELECT count(adjudicated) / count(*) FROM sheet), 6) AS completion FROM g""")
def review_conflicts(spark, sf_dir):
    s = review_sheet(spark, sf_dir)
    long = s.unpivot("doc_id", ["r1", "r2", "r3"], "reviewer", "v").groupBy("doc_id").agg(F.count("v").alias("n"), F.count_distinct("v").alias("d"))
    c = long.agg(F.count_if(F.col("n") >= 2).alias("double_reviewed"), F.count_if((F.col("n") >= 2) & (F.col("d") > 1)).alias("conflicts"))
    return c.crossJoin(s.agg(F.count("adjudicated").alias("adjudicated"), F.round(F.count("adjudicated") / F.count("*"), 6).alias("completion")))


@query(f"WITH {_SHEET} SELECT doc_id, 'reviewer_1_supported' AS field, r1::BIGINT AS answer FROM sheet WHERE r1 IS NOT NULL UNION ALL SELECT doc_id, 'reviewer_2_supported', r2 FROM sheet WHERE r2 IS NOT NULL UNION ALL SELECT doc_id, 'reviewer_3_supported', r3 FROM sheet WHERE r3 IS NOT NULL")
def form_unpivot(spark, sf_dir):
    long = review_sheet(spark, sf_dir).unpivot("doc_id", ["r1", "r2", "r3"], "reviewer", "v").where("v is not null")
    return long.select("doc_id", F.concat(F.lit("reviewer_"), F.regexp_extract("reviewer", r"(\d+)", 1), F.lit("_supported")).alias("field"), F.col("v").cast("bigint").alias("answer"))


@query("""WITH ref AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), a AS (SELECT doc_id FROM labels)
SELECT 'missing' AS kind, count(*) AS n FROM ref WHERE doc_id NOT IN (SELECT doc_id FROM a) UNION ALL SELECT 'extra', count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM ref)""")
def reference_gaps(spark, sf_dir):
    ref, a = documents(spark, sf_dir).where("doc_id % 2 = 0").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(ref.join(a, "doc_id", "left_anti"), "missing").unionByName(n(a.join(ref, "doc_id", "left_anti"), "extra"))


@query(rf"""WITH d AS (SELECT source, sha256(text) AS digest, min(doc_id) AS doc_id, any_value(length(text)) AS n_chars FROM documents WHERE len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) >= 30 GROUP BY ALL)
SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, digest) AS n FROM d) WHERE n <= 5""")
def shortest_first_quota(spark, sf_dir):
    """The five shortest different texts of thirty words or more of each source."""
    enough = documents(spark, sf_dir).where(X.word_count("text") >= 30)
    return B.shortest_first(enough, "source", "doc_id", "text", 5).withColumn("n_chars", F.col("n_chars").cast("bigint"))
