"""Stress conditions: rewritings of a clause that a robust system should survive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def _reordered(text: Column) -> Column:
    """Sentences in the order of their hashes."""
    parts = F.filter(F.transform(F.split(F.replace(text, F.lit(". "), F.lit(".|")), r"\|"), F.trim), lambda p: p != "")
    mixed = F.array_join(F.transform(F.array_sort(F.transform(parts, lambda p: F.struct(F.md5(p).alias("h"), p.alias("p")))), lambda x: x["p"]), " ")
    return F.coalesce(F.nullif(mixed, F.lit("")), text)


#: What scanning takes letters for.
OCR = {"l": "1", "I": "l", "O": "0", "rn": "m", "cl": "d"}


def with_noise(text: str | None) -> str | None:
    """One substitution per hundred characters (one at least), at places drawn from a hash of the text.

    Places are listed once; no place is changed twice, and where none is left nothing is, so the time is in proportion to the text.
    """
    import random
    import re
    import zlib

    if text is None:
        return None
    rng, changed = random.Random(zlib.crc32(text.encode())), {}
    places = {old: [m.start() for m in re.finditer(re.escape(old), text)] for old in OCR}
    for _ in range(max(1, len(text) // 100)):
        old = rng.choice(list(OCR))
        left = places[old]
        if left:
            at = rng.randrange(len(left))
            left[at], left[-1] = left[-1], left[at]
            at = left.pop()
            if not any(i in changed for i in range(at - 1, at + len(old))):
                changed[at] = old
    out, past = [], 0
    for at, old in sorted(changed.items()):
        out += [text[past:at], OCR[old]]
        past = at + len(old)
    return "".join([*out, text[past:]])


@F.pandas_udf(T.StringType())
def ocr_noise(texts: pd.Series) -> pd.Series:
    return texts.map(with_noise)


#: The conditions' names and prefixes.
CONDITIONS = {
    "baseline_clean": lambda t: t,
    "scanned_ocr_noise_proxy": ocr_noise,
    "reordered_clause_sentences": _reordered,
    "technical_derivative_language": lambda t: F.concat(F.lit("For the avoidance of doubt and subject to all applicable provisos, carve-outs, schedules, and cross-referenced definitions, "), t),
    "very_short_or_truncated": lambda t: X.first_words(t, 30),
    "unseen_jurisdiction": lambda t: F.concat(F.lit("Under the law of an unspecified foreign jurisdiction, "), t),
    "cross_clause_dependency": lambda t: F.concat(F.lit("Subject to Clause 14.3 and the exceptions in Schedule B, "), t),
}


def under_conditions(clauses: DataFrame, keys: list[str], text: str, names: list[str] | None = None) -> DataFrame:
    """keys, condition, text: every clause under each condition, in one pass."""
    chosen = names or list(CONDITIONS)
    made = F.array(*(F.struct(F.lit(n).alias("condition"), CONDITIONS[n](F.col(text)).alias("text")) for n in chosen))
    return clauses.select(*keys, F.explode(made).alias("x")).select(*keys, "x.condition", "x.text")


def incomplete_conditions(rows: DataFrame, key: str) -> DataFrame:
    """condition: those missing, or whose keys aren't the baseline's."""
    names = rows.sparkSession.createDataFrame([(n,) for n in CONDITIONS], "condition string")
    base = rows.where(F.col("condition") == "baseline_clean").select(key).distinct()
    n = base.count()
    have = rows.join(base.withColumn("in_base", F.lit(1)), key, "left").groupBy("condition").agg(F.count_distinct(key).alias("n"), F.max(F.col("in_base").isNull()).alias("odd"))
    return names.join(have, "condition", "left").where((F.coalesce("n", F.lit(-1)) != n) | F.coalesce("odd", F.lit(True))).select("condition")
