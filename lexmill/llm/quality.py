"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text gives a few counts.  Ratios of them, as integers, go into a log-linear
histogram per (lang, source): value ``v`` falls into the bin of its seven leading
binary digits, so a quantile read from it is at most 1/64 too small.  Such
sketches merge by adding counts: Spark's partial aggregation merges them over
tasks, a language's sketch is the sum of its sources', and the corpus's the sum
of all.  A group with too few rows for quantiles of its own takes its language's,
else the corpus's.

Fence of a measure: Q3 + max(``spread`` * (Q3 - Q1), slack).  A text over a fence
is rejected, as is one that fails the base rules.

Defined cases: a null or blank text has zero counts and fails the base rule
(under 50 words); null lang or source form groups of their own; equal rows are
judged alike; an empty table gives an empty result; ids may repeat or be null, as
nothing is joined by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import materialize, small_batches, unused

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
MIN_WORDS = 50

#: Measure: (numerator, denominator, scale, slack in scaled units).
MEASURES = {
    "word_length": ("word_chars", "n_words", 1000, 1500),
    "symbol_share": ("n_symbols", "word_chars", 10000, 500),
    "dup_line_share": ("n_dup_lines", "n_lines", 1000, 400),
    "repeat_share": ("n_repeat_words", "n_words", 1000, 400),
}
MIN_GROUP, SPREAD = 200, 4

# Fixed odd multipliers that mix three word hashes into a window hash.
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The BASE counts of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 3:
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        windows = h[:-2] * _MIX[0] + h[1:-1] * _MIX[1] + h[2:] * _MIX[2]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(windows), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(words), bool)
            covered[:-2] = twice
            covered[1:-1] |= twice
            covered[2:] |= twice
            repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _counted(columns: list[str], prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                counts = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, len(BASE))
                keep = [b.column(b.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*keep, *(pa.array(counts[:, i]) for i in range(len(BASE)))], [*columns, *(prefix + x for x in BASE)])

    return run


def with_counts(docs: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """``columns`` of ``docs`` and the BASE counts of its text."""
    small_batches(docs.sparkSession)
    source = docs.select(*dict.fromkeys([*columns, "text"]))
    fields = [source.schema[c] for c in columns] + [T.StructField(prefix + x, T.LongType(), False) for x in BASE]
    return source.mapInArrow(_counted(columns, prefix), T.StructType(fields))


def measure(name: str, prefix: str = "") -> Column:
    top, bottom, scale, _ = MEASURES[name]
    return F.coalesce(F.expr(f"({prefix}{top} * {scale}) div nullif({prefix}{bottom}, 0)"), F.lit(0).cast("bigint"))


def bin_of(v: Column) -> Column:
    """Lower edge of the log-linear bin of a non-negative integer: its seven leading binary digits."""
    drop = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(counted: DataFrame) -> DataFrame:
    """Mergeable sketch rows (lang, source, measure, bin, n); adding n merges two sketches."""
    long = counted.where(F.col("n_words") >= MIN_WORDS).select(
        "lang", "source",
        F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(measure(m)).alias("bin")) for m in MEASURES))).alias("x"),
    )
    return long.groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its rows, and the fence of each measure."""
    w = Window.partitionBy(*keys, "measure").orderBy("bin")
    ranked = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n")).select(
        *keys, "measure", "bin", F.sum("n").over(w).alias("upto"),
        F.sum("n").over(Window.partitionBy(*keys, "measure")).alias("total"),
    )
    q = {p: F.min(F.when(F.col("upto") * 4 >= F.col("total") * p, F.col("bin"))) for p in (1, 3)}
    slack = F.create_map(*(F.lit(x) for m, v in MEASURES.items() for x in (m, v[3])))[F.col("measure")]
    per = ranked.groupBy(*keys, "measure").agg(q[1].alias("q1"), q[3].alias("q3"), F.max("total").alias("total")).withColumn(
        "fence", F.col("q3") + F.greatest(SPREAD * (F.col("q3") - F.col("q1")), slack)
    )
    pick = [F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(m) for m in MEASURES]
    return per.groupBy(*keys).agg(F.max("total").alias("total"), *pick)


def thresholds(counted: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, fence per measure): a group's own, its language's, or the corpus's."""
    sketch = materialize(sketches(counted), "quality-sketch")
    own, lang, corpus = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"]), _fences(sketch, [])
    for m in ["total", *MEASURES]:
        lang, corpus = lang.withColumnRenamed(m, "l_" + m), corpus.withColumnRenamed(m, "c_" + m)
    joined = own.join(lang.withColumnRenamed("lang", "l_lang"), F.col("lang").eqNullSafe(F.col("l_lang")), "left").withColumn("one", F.lit(1)).join(
        corpus.withColumn("one", F.lit(1)), "one", "left"
    )
    pick = lambda m: F.when(F.col("total") >= min_group, F.col(m)).when(F.col("l_total") >= min_group, F.col("l_" + m)).otherwise(F.col("c_" + m))
    return joined.select("lang", "source", *(pick(m).alias("f_" + m) for m in MEASURES))


def _failed(prefix: str = "") -> Column:
    return (F.col(prefix + "n_words") < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > 50 * F.col(prefix + "n_words"))


def _judged(counted: DataFrame, fences: DataFrame, prefix: str = "") -> DataFrame:
    """Joins the fences by (lang, source), null-safe; adds <prefix>base_failed and <prefix>kept."""
    t = fences.select(F.col("lang").alias(prefix + "t_lang"), F.col("source").alias(prefix + "t_source"), *(F.col("f_" + m).alias(f"{prefix}f_{m}") for m in MEASURES))
    on = F.col("lang").eqNullSafe(F.col(prefix + "t_lang")) & F.col("source").eqNullSafe(F.col(prefix + "t_source"))
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(measure(m, prefix) <= F.col(f"{prefix}f_{m}"), F.lit(True))
    return counted.join(t, on, "left").withColumn(prefix + "base_failed", _failed(prefix)).withColumn(prefix + "kept", ~_failed(prefix) & inside)


def quality_verdicts(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts and verdict per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, lang, source."""
    counted = materialize(with_counts(docs, ["doc_id", "lang", "source"]), "quality-counts")
    judged = _judged(counted, materialize(thresholds(counted, min_group), "quality-fences"))
    return judged.select("doc_id", *BASE[:5], "base_failed", "kept", "lang", "source")


def quality_filter(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The fences come from one pass that moves counts only; a second pass counts
    again and filters where each row stands, so texts are not shuffled as long
    as the fence table (a row per lang and source) is small enough for Spark to
    send it to the tasks.
    """
    p = unused(docs, "quality_of")
    counted = with_counts(docs, ["lang", "source"])
    fences = materialize(thresholds(counted, min_group), "quality-fences")
    judged = _judged(with_counts(docs, docs.columns, p), fences, p)
    return judged.where(F.col(p + "kept")).select(*(docs.columns))
