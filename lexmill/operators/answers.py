"""Questions answered from retrieved evidence, and the answers' measures.

The answer is extractive, in place of a generator: the sentence of the evidence that has
most of the question's words.  Support is the entailment of the answer by all its evidence, and
the judge's mark a fixed rule over the token F1; both are replaceable like other models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .verify import token_share

#: Said where no sentence shares a word with the question.
INSUFFICIENT = "The evidence is insufficient."


def grounded_answers(questions: DataFrame, evidence: DataFrame, longest: int = 40) -> DataFrame:
    """q_id, answer, chunk_id, score, support of each question (q_id, question) and its evidence (q_id, rank, chunk_id, text).

    The first of the best sentences, by rank and place, cut to ``longest`` words.  Without any
    evidence support is 0; a null text is no evidence.  Texts are cut into sentences where they
    stand, once each, and only sentences that share a word with a question go on.
    """
    read = lambda c: F.array_distinct(X.tokens(c))
    asked = questions.select("q_id", "question", read(F.coalesce("question", F.lit(""))).alias("wanted"))
    ev = evidence.where(F.col("text").isNotNull())
    parts = ev.join(asked, "q_id").select("q_id", "wanted", "rank", "chunk_id", F.posexplode(X.sentences("text")).alias("pos", "sentence"))
    scored = parts.withColumn("score", token_share(read("sentence"), F.col("wanted"))).where("score > 0")
    best = scored.groupBy("q_id").agg(F.max_by(F.struct("chunk_id", "score", "sentence"), F.struct("score", -F.col("rank"), -F.col("pos"))).alias("b"))
    said = asked.join(best, "q_id", "left").select(
        "q_id", "question", F.when(F.col("b").isNotNull(), X.first_words("b.sentence", longest)).otherwise(INSUFFICIENT).alias("answer"), "b.chunk_id", F.coalesce("b.score", F.lit(0.0)).alias("score")
    )
    # Support: the answer's words that stand in any of its evidence; sets of words are joined, not texts.
    held = ev.join(said.select("q_id", read("answer").alias("words")), "q_id").groupBy("q_id").agg(F.flatten(F.collect_list(F.array_intersect("words", read("text")))).alias("found"))  # a question's few pieces
    share = token_share(F.array_distinct("found"), read("answer"))
    return said.join(held, "q_id", "left").select("q_id", "question", "answer", "chunk_id", "score", F.when(F.col("found").isNotNull(), share).otherwise(0.0).alias("support"))


def judged(f1: Column) -> Column:
    """The judge's mark from 1 to 5."""
    return F.least(F.lit(5), F.greatest(F.lit(1), F.round(1 + 4 * f1).cast("int")))


def answer_measures(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """q_id, token_f1, support, mark of each answer that has a gold answer (q_id, gold)."""
    f1 = F.round(X.token_f1("answer", "gold"), 9)
    return answers.join(gold, "q_id").select("q_id", f1.alias("token_f1"), "support").withColumn("mark", judged(F.col("token_f1")))
