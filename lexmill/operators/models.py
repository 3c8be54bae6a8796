"""Models as pluggable functions, each with a deterministic stand-in.

A model is registered under its task; queries ask for the task.  The stand-ins are
Column expressions or Arrow functions with fixed rules; they measure no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow_text as A
from ..functions import text as X
from ..session import ship, stored
from .resample import numbered
from .verify import nli, token_recall

_models: dict[str, Callable[..., Any]] = {"nli": nli, "entailment": token_recall, "rewrite": X.split_long_clauses}


def register(task: str, model: Callable[..., Any]) -> None:
    _models[task] = model


def model(task: str) -> Callable[..., Any]:
    if task not in _models:
        raise KeyError(f"no model for {task}")
    return _models[task]


@F.arrow_udf(T.ArrayType(T.FloatType()))
def embed(texts: pa.Array) -> pa.Array:
    """Unit vectors of 64 hashed token counts; a slice of the batch's texts is worked on at a time."""
    done = [np.empty((0, 64), np.float32)]
    for b in A.slices(pa.record_batch([texts], ["text"]), 0):
        length, tokens = A.cut_tokens(b.column(0))
        coded = tokens.dictionary_encode()
        bucket = np.array([crc32(w.encode()) % 64 for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        v = np.bincount(np.repeat(np.arange(len(b)), length) * 64 + bucket, minlength=len(b) * 64).reshape(len(b), 64).astype(np.float32)
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        done.append(v / np.where(norm == 0, np.float32(1), norm))
    v = np.concatenate(done)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 64), pa.int32()), pa.array(v.ravel(), pa.float32()))


register("embedding", embed)
register("cross_encoder", lambda query, text: token_recall(text, query))


def rewrite_until_simple(clauses: DataFrame, key: str, text: str, target: float = 7.0, least: float = 0.75, retries: int = 7) -> DataFrame:
    """key, attempts, text, grade, entailment, accepted.

    Attempt i keeps the first ``retries + 2 - i`` parts of the split clause (a stand-in for
    sampling at rising temperature); attempts are rows, so the choice among them is one
    aggregation: of those that are entailed the simplest, else the most faithful.
    """
    parts = F.split(model("rewrite")(F.col(text)), r"(?<=[.!?]) ")
    tries = F.explode(F.sequence(F.lit(1), F.lit(retries + 1)))
    drafts = clauses.select(key, F.col(text).alias("__source"), parts.alias("__parts"), tries.alias("attempt")).select(
        key, "attempt", "__source", F.array_join(F.slice("__parts", F.lit(1), F.greatest(F.size("__parts") - F.col("attempt") + 1, F.lit(1))), " ").alias("draft")
    )
    scored = drafts.select(key, "attempt", "draft", X.fk_grade("draft").alias("grade"), model("entailment")(F.col("__source"), F.col("draft")).alias("entailment"))
    ok = F.col("entailment") >= least
    order = F.struct((~ok).alias("a"), F.when(ok, F.col("grade")).otherwise(-F.col("entailment")).alias("b"), F.when(ok, -F.col("entailment")).otherwise(F.col("grade")).alias("c"), "attempt")
    best = scored.groupBy(key).agg(F.min_by(F.struct("attempt", "draft", "grade", "entailment"), order).alias("x"))
    return best.select(key, "x.*", ((F.col("x.grade") <= target) & (F.col("x.entailment") >= least)).alias("accepted"))


def in_batches(rows: DataFrame, columns: list[str], call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run an external model over Arrow batches; adds error, null where the call went well.

    Rows of a batch that fails come back with the error's text, their own values in the
    columns that ``schema`` shares with them and null in the others, to be asked for again.
    """
    ship(rows.sparkSession)
    out = T.StructType.fromDDL(schema)
    names = out.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield call(b)[names].assign(error=None)
            except Exception as e:  # the service's failure, not ours
                yield pd.DataFrame({n: b[n] if n in b.columns else None for n in names}, index=b.index).assign(error=f"{type(e).__name__}: {e}")

    return rows.select(*columns).mapInPandas(run, T.StructType([*out.fields, T.StructField("error", T.StringType())]))


def train_classifier(rows: DataFrame, features: str, label: str, classes: list[str], seed: int = 42):
    """A class-balanced logistic regression on vectors, in place of the frozen-embedding head."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = rows.groupBy(label).count()
    weights = {r[label]: r["count"] for r in n.collect()}  # one number a class
    total = sum(weights.values())
    code, weight = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i, c in enumerate(classes):
        code, weight = F.when(F.col(label) == c, float(i)).otherwise(code), F.when(F.col(label) == c, total / (len(classes) * max(1, weights.get(c, 0)))).otherwise(weight)
    data = rows.select(array_to_vector(features).alias("features"), code.alias("label"), weight.alias("weight")).where("label is not null")
    return LogisticRegression(maxIter=50, weightCol="weight", regParam=0.01).fit(data)


def predicted(fitted, rows: DataFrame, features: str, classes: list[str]) -> DataFrame:
    """rows with predicted_label and confidence."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = fitted.transform(rows.withColumn("features", array_to_vector(features)))
    names: Column = F.array(*map(F.lit, classes))
    p = vector_to_array("probability")
    return out.select(*rows.columns, F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted_label"), F.array_max(p).alias("confidence"))


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int = 5) -> DataFrame:
    """key, fold: rows in the order of (label, hash of the key) are dealt round, so that each class's folds differ by one row at most.

    Rows without a label have no fold.
    """
    order = F.md5(F.col(key).cast("string"))
    n = numbered(rows.where(F.col(label).isNotNull()).select(key, F.col(label).alias("of"), order.alias("order")), ["of", "order", key])
    return n.select(key, (F.col("idx") % folds).cast("int").alias("fold"))


def out_of_fold(rows: DataFrame, key: str, features: str, label: str, classes: list[str], folds: int = 5) -> DataFrame:
    """key, fold, label, predicted_label, confidence: every labelled row scored by a model fitted on the other folds."""
    dealt = stored(rows.join(stratified_folds(rows, key, label, folds), key).select(key, "fold", label, features), "folds")
    out = None
    for f in range(folds):
        fitted = train_classifier(dealt.where(F.col("fold") != f), features, label, classes)
        part = predicted(fitted, dealt.where(F.col("fold") == f), features, classes).drop(features)
        out = part if out is None else out.unionByName(part)
    return out
