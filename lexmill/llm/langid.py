"""Language identification: nearest centroid of normalised TF-IDF n-gram vectors.

A text becomes the counts of its letter n-grams (one to three code points of the lower-cased
text, everything but letters and marks being one space), hashed into ``2 ** BITS`` buckets,
weighted by log(1 + count) times the bucket's inverse document frequency, and scaled to length
one.  Every language has up to ``CLUSTERS`` centroids, found by spherical k-means, as one
language may be written in several ways.  A text takes the language of the centroid with the
highest cosine.  Rejection by distance: each centroid has a radius, the largest distance of its
own sample texts plus a slack; a text outside the radius of its nearest centroid is told apart
as ``rejected``, whatever language comes nearest.

Document frequencies are counted over all texts to learn from.  The centroids are fitted on a
bounded sample: ``SAMPLE`` different texts per language, those with the smallest hashes of the
text; and ``LANGUAGES`` languages at most, those with the most texts.  Both are parameters.  So
the model's size has a bound (languages * clusters * KEPT weights) and is sent to the tasks.
Texts are read whole.  Nothing but the text enters a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and not learned from;
a null lang isn't learned from, an empty one is a language like others; equal texts get equal
answers; ties go to the language first in the alphabet; if there is nothing to learn from, every
text is ``und``; a text none of whose n-grams occur in a centroid has score 0 and the first language; a null id
counts as the empty text where documents are held out, repeated ids are rows of their own; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialize, small_batches

BITS, SAMPLE, CLUSTERS, LANGUAGES, KEPT = 14, 200, 4, 1000, 4096
TURNS, SLACK = 8, 0.05
UNKNOWN = "und"

# Fixed odd multipliers of the n-gram hashes.
_MIX = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


@lru_cache(maxsize=1)
def letter_kinds() -> np.ndarray:
    """Per code point: 2 for letters, 1 for marks, 0 for all else."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(sys.maxunicode + 1)], np.uint8)


def gram_counts(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's n-grams; nothing if the text has no letter."""
    none = np.empty(0, np.int64)
    if not text:
        return none, none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = letter_kinds()[points]
    if not (kind == 2).any():
        return none, none
    inside = kind > 0
    held = np.concatenate([inside[:1], inside[1:] | inside[:-1]])  # of a run of others the first stays, as a space
    x = np.concatenate([[32], np.where(inside, points, 32)[held], [32]]).astype(np.uint32)
    one = x * _MIX[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _MIX[1] + x[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _MIX[2] + x[2:]
    hashed = np.concatenate([one, two * _MIX[1], three * _MIX[0]])
    hashed ^= hashed >> np.uint32(16)
    counts = np.bincount((hashed * _MIX[2]) >> np.uint32(32 - bits), minlength=1 << bits)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


def weights(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The normalised TF-IDF weights of the buckets."""
    w = np.log1p(counts) * idf[buckets]
    return w / np.sqrt((w * w).sum())


class Model(NamedTuple):
    idf: np.ndarray
    langs: list[str]  # of each centroid, sorted
    centroids: np.ndarray  # (buckets, centroids)
    radius: np.ndarray


def predict(text: str | None, model: Model) -> tuple[str, float, bool]:
    """(nearest language, cosine, rejected)."""
    buckets, counts = gram_counts(text)
    if not len(buckets) or not model.langs:
        return UNKNOWN, 0.0, True
    near = weights(buckets, counts, model.idf) @ model.centroids[buckets]
    best = int(near.argmax())
    score = float(min(1.0, max(0.0, near[best])))
    return model.langs[best], score, 1.0 - score > model.radius[best]


def clusters(vectors: np.ndarray, k: int, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of rows of length one: (centroids, the centroid of each row).

    Starts from the row nearest to the mean, then from the row farthest from all starts so far.
    """
    starts = [int((vectors @ vectors.mean(0)).argmax())]
    near = vectors @ vectors[starts[0]]
    while len(starts) < min(k, len(vectors)):
        starts.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[starts[-1]])
    centres = vectors[starts]
    for _ in range(turns):
        own = (vectors @ centres.T).argmax(1)
        sums = np.stack([vectors[own == c].sum(0) for c in range(len(centres))])
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres, (vectors @ centres.T).argmax(1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [gram_counts(t) for t in b.column("text").to_pylist()]
        pick = [i for i, (x, _) in enumerate(found) if len(x)]
        yield pa.RecordBatch.from_arrays(
            [b.column("lang").take(pa.array(pick, pa.int64())), pa.array([found[i][0] for i in pick], pa.list_(pa.int64())), pa.array([found[i][1] for i in pick], pa.list_(pa.int64()))],
            ["lang", "buckets", "counts"],
        )


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the texts that hold each bucket; bucket -1 counts the texts with a letter."""
    held, texts = np.zeros(1 << BITS, np.int64), 0
    for b in batches:
        for t in b.column(0):
            buckets, _ = gram_counts(t.as_py())
            held[buckets] += 1
            texts += len(buckets) > 0
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int32()), pa.array([texts, *held[some]], pa.int64())], ["bucket", "n"])


def _centroids(idf, k: int, kept: int):
    """Of a language's sample: its centroids as the ``kept`` largest weights, and radii."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")  # a fixed order: sums of floats don't depend on the shuffle
        vectors = np.zeros((len(rows), 1 << BITS))
        for i, (b, c) in enumerate(zip(rows["buckets"], rows["counts"], strict=True)):
            vectors[i, b] = weights(b, c, idf.value)
        centres, own = clusters(vectors, k)
        out = []
        for c in range(len(centres)):
            members = vectors[own == c]
            if not len(members):
                continue
            top = np.sort(np.argsort(-centres[c], kind="stable")[:kept])
            top = top[centres[c][top] > 0]
            w = centres[c][top] / np.sqrt((centres[c][top] ** 2).sum())
            out.append((key[0], c, top.tolist(), w.tolist(), float(1 - (members[:, top] @ w).min())))
        return pd.DataFrame(out, columns=["lang", "cluster", "buckets", "weights", "radius"])

    return run


def train(texts: DataFrame, sample: int = SAMPLE, k: int = CLUSTERS, languages: int = LANGUAGES, kept: int = KEPT) -> Model:
    """Fit on ``texts`` (text, lang)."""
    spark = texts.sparkSession
    small_batches(spark)
    usable = texts.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", F.col("lang").cast("string").alias("lang"))
    held = usable.select("text").mapInArrow(_presence, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row a bucket at most
    found = {r["bucket"]: r["n"] for r in held}
    df = np.array([found.get(i, 0) for i in range(1 << BITS)])
    idf = np.log((1 + found.get(-1, 0)) / (1 + df)) + 1

    hashed = usable.select("lang", F.xxhash64("text").alias("h"))
    per = hashed.groupBy("lang", "h").agg(F.count("*").alias("n"))  # copies of a text count once in the sample
    per = materialize(per, "language-texts")
    chosen = per.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    rank = Window.partitionBy("lang").orderBy("h")
    picked = materialize(per.join(F.broadcast(chosen), "lang").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= sample).select("lang", "h"), "language-sample")
    # ``sample * languages`` rows at most.
    one = usable.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))
    sent = spark.sparkContext.broadcast(idf)
    features = one.select(F.struct("lang", "h").alias("lang"), "text").mapInArrow(_features, "lang struct<lang:string,h:bigint>, buckets array<bigint>, counts array<bigint>")
    flat = features.select("lang.lang", "lang.h", "buckets", "counts")
    rows = flat.groupBy("lang").applyInPandas(_centroids(sent, k, kept), "lang string, cluster int, buckets array<bigint>, weights array<double>, radius double")
    fitted = sorted(rows.collect(), key=lambda r: (r["lang"].encode("utf-8", "surrogatepass"), r["cluster"]))  # ``languages * k`` rows of ``kept`` weights at most
    centroids = np.zeros((1 << BITS, len(fitted)), np.float32)
    for i, r in enumerate(fitted):
        centroids[r["buckets"], i] = r["weights"]
    return Model(idf, [r["lang"] for r in fitted], centroids, np.array([r["radius"] + SLACK for r in fitted]))


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            found = [predict(t.as_py(), model) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                [*b.schema.names[1:], "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Model, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns, lang_pred, score, rejected of every row."""
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in carried)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("text").alias("read"), *carried).mapInArrow(_predict(sent), f"{schema}lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def predicted_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the documents that aren't held out.

    ``lang_pred`` is the nearest learned language also where the distance rejects it.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model, ("doc_id", "held_out"))
