"""Sentences against their source and their evidence, with a deterministic stand-in for the entailment model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow_text as A
from ..functions import text as X
from ..session import ship
from . import retrieval as R

Scorer = Callable[[Column, Column], Column]


def token_share(premise: Column, hypothesis: Column) -> Column:
    """Share of the distinct tokens in ``hypothesis`` that ``premise`` has; both are arrays of distinct tokens."""
    return X.rounded(F.coalesce(F.try_divide(F.size(F.array_intersect(hypothesis, premise)), F.size(hypothesis)), F.lit(0.0)), 9)


def token_recall(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis's distinct tokens that stand in the premise."""
    return token_share(F.array_distinct(X.tokens(premise)), F.array_distinct(X.tokens(hypothesis)))


def nli(premise: Column, hypothesis: Column) -> Column:
    """struct(entailment, neutral, contradiction) of the stand-in."""
    e = token_recall(premise, hypothesis)
    return F.struct(e.alias("entailment"), ((1 - e) / 2).alias("neutral"), ((1 - e) / 2).alias("contradiction"))


def verify(sentences: DataFrame, evidence: DataFrame, tau: float, attribution_tau: float, score: Scorer = token_recall) -> DataFrame:
    """clause_id, pos, source, regulatory, candidate_chunk, chunk_id, supported.

    Each sentence (clause_id, pos, sentence, clause) meets the evidence of its clause
    (clause_id, rank, chunk_id, text); the best chunk is the first of the highest scores,
    and is attributed from ``attribution_tau`` on.
    """
    # The stand-in reads tokens: they are cut once a text, not once a pair.
    read = (lambda c: F.array_distinct(X.tokens(c))) if score is token_recall else F.col
    judge = token_share if score is token_recall else score
    ev = evidence.select("clause_id", "rank", F.col("chunk_id").alias("chunk"), read("text").alias("chunk_text"))
    said = sentences.select("clause_id", "pos", read("clause").alias("clause"), read("sentence").alias("sentence"))
    own = said.select("clause_id", "pos", judge(F.col("clause"), F.col("sentence")).alias("source"))
    pairs = said.select("clause_id", "pos", "sentence").join(ev, "clause_id", "left").select(
        "clause_id", "pos", "rank", "chunk", F.when(F.col("chunk").isNotNull(), judge(F.col("chunk_text"), F.col("sentence"))).alias("s")
    )
    best = pairs.groupBy("clause_id", "pos").agg(F.max("s").alias("regulatory"), F.max_by("chunk", F.struct("s", -F.col("rank"))).alias("candidate_chunk"))
    return own.join(best, ["clause_id", "pos"]).select(
        "clause_id", "pos", "source", "regulatory", "candidate_chunk",
        F.when(F.col("regulatory") >= attribution_tau, F.col("candidate_chunk")).alias("chunk_id"), (F.coalesce("regulatory", F.lit(0.0)) >= tau).alias("supported"),
    )


def _among(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys are among the ascending ``held``."""
    if not len(held):
        return np.zeros(len(keys), bool)
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys


def _counted(clauses: pa.StringArray, said: pa.ListArray, small: tuple, held: np.ndarray, top_j: int) -> pa.StructArray:
    """Evidence and common tokens of a slice's clauses and their sentences; ``held`` are the chunks' (chunk, term), numbered through."""
    vocabulary, ids = small[0], small[-1]
    cut = A.cut_tokens(clauses)
    found = R.first_documents(cut, small, top_j)
    sizes = pc.fill_null(pc.list_value_length(said), 0).to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(clauses)), sizes)
    lengths, words = A.cut_tokens(said.flatten())
    coded = pa.concat_arrays([cut[1], words]).dictionary_encode()
    code, width = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    of_clauses = np.unique(np.repeat(np.arange(len(clauses)), cut[0]) * width + code[: len(cut[1])])
    pairs = np.unique(np.repeat(np.arange(len(owner)), lengths) * width + code[len(cut[1]) :])
    sentence, token = pairs // width, pairs % width
    count = lambda hit: np.bincount(sentence[hit], minlength=len(owner))
    own = count(_among(owner[sentence] * width + token, of_clauses))
    term = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy().astype(np.int64)[token]
    best, chunk = np.full(len(owner), -1), np.full(len(owner), -1)
    for at in found:
        at = at[owner]
        n = np.where(at >= 0, count((term >= 0) & (at[sentence] >= 0) & _among(at[sentence] * len(vocabulary) + term, held)), -1)
        better = n > best  # the first of equal ones stays
        best[better], chunk[better] = n[better], at[better]
    names = ids.take(pa.array(chunk, pa.int64(), mask=chunk < 0)).cast(pa.string())
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    columns = {"tokens": pa.array(count(slice(None)), pa.int32()), "own": pa.array(own, pa.int32()), "best": pa.array(best, pa.int32(), mask=chunk < 0), "chunk_id": names}
    sentences = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))
    return pa.StructArray.from_arrays([pa.array((found >= 0).sum(0), pa.int32()), sentences], ["n_evidence", "sentences"])


def in_rows(chunks: DataFrame, top_j: int, attribution_tau: float) -> Callable[[str, str], Column] | None:
    """``bm25`` of ``top_j`` chunks (doc_id, text) and ``verify`` by tokens, for a clause and the array of its sentences in one row.

    The column is a struct: n_evidence, and sentences as array of struct (source, regulatory,
    chunk_id).  A clause's tokens are cut once, and no text leaves its row.  None if the chunks'
    terms are too many to be sent to the tasks.
    """
    ship(chunks.sparkSession)
    sent = R.sent_documents(chunks)
    if sent is None:
        return None

    @F.arrow_udf("n_evidence int, sentences array<struct<tokens:int,own:int,best:int,chunk_id:string>>")
    def counted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        small = sent.value
        vocabulary, starts, at = small[:3]
        held = np.sort(at * len(vocabulary) + np.repeat(np.arange(len(vocabulary)), np.diff(starts)))
        for clauses, said in batches:
            whole = pa.RecordBatch.from_arrays([said.cast(pa.list_(pa.string())), clauses], ["said", "clause"])
            out = [_counted(b.column(1), b.column(0), small, held, top_j) for b in A.slices(whole)]
            yield pa.concat_arrays(out) if out else pa.nulls(0, EMPTY)

    share = lambda s, n: X.rounded(F.coalesce(F.try_divide(s[n], s["tokens"]), F.lit(0.0)), 9)

    def judged(s: Column) -> Column:
        best = F.when(s["chunk_id"].isNotNull(), share(s, "best"))
        return F.struct(share(s, "own").alias("source"), best.alias("regulatory"), F.when(best >= attribution_tau, s["chunk_id"]).alias("chunk_id"))

    def of(clause: str, sentences: str) -> Column:
        return X.let(counted(F.col(clause), F.col(sentences)), lambda x: F.struct(x["n_evidence"].cast("bigint").alias("n_evidence"), F.transform(x["sentences"], judged).alias("sentences")))

    return of


#: What the tasks give for a clause.
EMPTY = pa.struct([("n_evidence", pa.int32()), ("sentences", pa.list_(pa.struct([("tokens", pa.int32()), ("own", pa.int32()), ("best", pa.int32()), ("chunk_id", pa.string())])))])
