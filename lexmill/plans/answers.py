"""Questions answered from evidence, and rerankers over the same candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import text as X
from ..operators import answers as A
from ..operators import benchmark as B
from ..operators import metrics as M
from ..operators import retrieval as R
from ..session import stored
from . import retrieval
from .retrieval import _TOK
from .text import SENTENCES_SQL, WORDS_SQL

_ASK = f"SELECT item_id AS q_id, array_to_string({WORDS_SQL}[1:12], ' ') AS text FROM benchmark"
_SET = f"list_distinct({_TOK})"
_SHARE = "round(coalesce(len(list_intersect({0}, {1})) / nullif(len({0}), 0), 0), 9)"
_CUT = r"array_to_string(list_filter(string_split_regex(sentence, '\s+'), lambda w: w <> '')[1:40], ' ')"
#: Answers of the benchmark's openings, as questions, from the three best documents; the passage is the gold answer.
ANSWERS = f"""{retrieval.bm25_sql(_ASK)}, ev AS (SELECT q_id, rank, doc_id, text FROM rk JOIN documents USING (doc_id) WHERE rank <= 3),
 snt AS (SELECT e.q_id, e.rank, e.doc_id, pos, trim(s) AS sentence FROM (SELECT q_id, rank, doc_id, {SENTENCES_SQL} AS ss FROM ev) e, unnest(ss) WITH ORDINALITY AS t(s, pos)),
 sca AS (SELECT snt.*, {_SHARE.format(_SET.format('qs.text'), _SET.format('sentence'))} AS score FROM snt JOIN qs USING (q_id)),
 bs AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, rank, pos) AS n FROM sca WHERE score > 0),
 an AS (SELECT qs.q_id, coalesce({_CUT}, '{A.INSUFFICIENT}') AS answer, doc_id AS chunk_id, coalesce(score, 0.0) AS score FROM qs LEFT JOIN bs ON bs.q_id = qs.q_id AND n = 1),
 ew AS (SELECT q_id, list_distinct(flatten(list({_TOK.format('text')}))) AS words FROM ev GROUP BY q_id),
 su AS (SELECT an.*, coalesce({_SHARE.format(_SET.format('answer'), 'words')}, 0.0) AS support FROM an LEFT JOIN ew USING (q_id))"""
_LIST = r"list_filter(string_split_regex(lower({}), '\s+'), lambda w: w <> '')"
_F1 = f"""ga AS (SELECT su.*, {_LIST.format('answer')} AS aw, {_LIST.format('b.text')} AS gw FROM su JOIN benchmark b ON b.item_id = su.q_id),
 gf AS (SELECT *, list_sum(list_transform(list_distinct(list_intersect(aw, gw)), lambda w: least(len(list_filter(aw, lambda x: x = w)), len(list_filter(gw, lambda x: x = w))))) AS o FROM ga),
 gm AS (SELECT q_id, support, round(coalesce(2 * (o / len(aw)) * (o / len(gw)) / nullif(o / len(aw) + o / len(gw), 0), 0.0), 9) AS f1 FROM gf)"""


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), X.first_words("text", 12).alias("question"))


def answered(spark, sf_dir):
    asked, texts = _questions(spark, sf_dir), retrieval.texts(spark, sf_dir)
    found = R.bm25(asked.select("q_id", F.col("question").alias("text")), texts, 3).select("q_id", "doc_id", "rank")
    evidence = found.join(texts, "doc_id").select("q_id", "rank", F.col("doc_id").alias("chunk_id"), "text")
    return A.grounded_answers(asked, evidence)


@query(f"WITH {ANSWERS} SELECT q_id, answer, chunk_id, round(score, 6) AS score, round(support, 6) AS support FROM su")
def grounded_answers(spark, sf_dir):
    return answered(spark, sf_dir).select("q_id", "answer", "chunk_id", F.round("score", 6).alias("score"), F.round("support", 6).alias("support"))


@query(f"""WITH {ANSWERS}, {_F1} SELECT count(*) AS n, round(avg(f1), 6) AS answer_token_f1, round(avg(support), 6) AS evidence_entailment, round(avg(least(5, greatest(1, round(1 + 4 * f1)))), 6) AS correctness_1_to_5 FROM gm""")
def qa_answer_evaluation(spark, sf_dir):
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("gold"))
    m = A.answer_measures(answered(spark, sf_dir), gold)
    mean = lambda c: F.round(F.avg(c), 6)
    return m.agg(F.count("*").alias("n"), mean("token_f1").alias("answer_token_f1"), mean("support").alias("evidence_entailment"), mean("mark").alias("correctness_1_to_5"))


_POOL = f"""{retrieval.bm25_sql()}, {retrieval.GOLD}, {retrieval.DENSE},
 un AS (SELECT q_id, doc_id, min(o) AS o FROM (SELECT q_id, doc_id, rank AS o FROM dr WHERE rank <= 20 UNION ALL SELECT q_id, doc_id, 100000 + rank FROM rk WHERE rank <= 20) GROUP BY ALL),
 pl AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY o, doc_id) AS place FROM un),
 tk AS (SELECT pl.*, {_SET.format('b.text')} AS a, {_SET.format('d.text')} AS t FROM pl JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = pl.q_id),
 ss AS (SELECT q_id, doc_id, place, round(len(list_intersect(a, t)) / len(a), 9) AS overlap, round(len(list_intersect(a, t)) / len(list_distinct(list_concat(a, t))), 9) AS jaccard FROM tk),
 sy AS (SELECT 'order_of_candidates' AS system, q_id, doc_id, place AS rank FROM ss UNION ALL SELECT 'overlap', q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY overlap DESC, place) FROM ss
  UNION ALL SELECT 'jaccard', q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY jaccard DESC, place) FROM ss)"""
_SYSTEM = "SELECT '{0}' AS system, * FROM (WITH t AS (SELECT q_id, doc_id, rank FROM sy WHERE system = '{0}'), " + retrieval._MULTI.format(top="t", k=5) + f" SELECT {retrieval._AVG} FROM pq)"


@query(f"WITH {_POOL} " + " UNION ALL ".join(_SYSTEM.format(s) for s in ("order_of_candidates", "overlap", "jaccard")))
def reranker_comparison(spark, sf_dir):
    """Rerankers on the union of the dense and the lexical candidates, the first occurrence of each counting."""
    asked, texts = retrieval.passages(spark, sf_dir), retrieval.texts(spark, sf_dir)
    pool = B.first_seen_candidates(R.hashed_dense(asked, texts, 20), retrieval.lexical(spark, sf_dir, 20)).withColumnRenamed("place", "rank")
    pool = stored(pool, "candidates")  # so that their size is known
    texts = texts.join(pool.select("doc_id"), "doc_id", "left_semi")
    held = lambda key, name, t: t.select(key, F.array_distinct(F.transform(X.tokens("text"), lambda x: F.xxhash64(x))).alias(name))
    both = pool.join(held("doc_id", "t", texts), "doc_id").join(held("q_id", "a", asked), "q_id")
    share = lambda size: F.round(F.try_divide(F.size(F.array_intersect("a", "t")), size), 9)
    scored = both.select("q_id", "doc_id", "rank", (-F.col("rank").cast("double")).alias("order_of_candidates"), share(F.size("a")).alias("overlap"), share(F.size(F.array_union("a", "t"))).alias("jaccard"))
    gold = retrieval.gold(spark, sf_dir)
    out = None
    for system in ("order_of_candidates", "overlap", "jaccard"):
        ranks = R.rerank(scored.select("q_id", "doc_id", "rank", F.col(system).alias("s")), F.col("s"), 5).select("q_id", "doc_id", F.col("new_rank").alias("rank"))
        part = M.retrieval_multi(ranks, gold, 5).select(F.lit(system).alias("system"), "*")
        out = part if out is None else out.unionByName(part)
    return out
