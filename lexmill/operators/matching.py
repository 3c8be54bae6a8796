"""One-to-one matching of similar lines, document by document.

Pairs are taken in the order of (similarity, predicted place, gold place), largest first, and
use up both of their lines.  Similarity is difflib's ratio: twice the matched characters by all.

Nothing is compared with everything:

* Equal lines come first in that order and are paired by their ranks from the end.
* What is left meets in rungs of falling similarity.  Pairs of a rung share one of the rarest
  q-grams of both lines: M matched characters of lines of n and m lie in at most n + m - 2M + 1
  blocks, so M - (q - 1)(n + m - 2M + 1) grams are common, and one of them is among the rarest
  (grams - common + 1) of each side.  Lines too short for that share one of their rarest characters.
  The first rung needs few grams and uses up most lines; only the others go on to the next.
* Of the candidates, bounds from lengths, character counts and the longest common subsequence,
  which holds all of difflib's blocks, leave those for difflib.

The pairs of a rung are decided by local dominance: a pair that is the first of both of its
lines in the order would be taken whatever comes between, so all such pairs are taken at once,
their lines' other pairs go, and it starts again.  This gives the rows of a scan in order.
Documents with ``IN_TASK`` pairs at most do their rounds in a task, larger ones in joins.

``match_clauses`` has a document's lines in its row: there up to ``IN_ROW`` pairs are matched where
they stand, and only documents with more go the way above.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from heapq import heappop, heappush
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship, stored

#: Similarities of the rungs above the least one asked for.
RUNGS = (0.95,)
#: Gram length of lines that are long enough; pairs decided in one task; buckets of the gram frequencies.
GRAM, IN_TASK, BUCKETS = 3, 200_000, 1 << 16
#: Pairs of unequal lines of a document that are held at once in its row.
IN_ROW = 1 << 20
#: From this length on difflib leaves out characters that make up over a hundredth of the second line.
JUNK_FROM = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)


def partner_lengths(n: int, least: float) -> range:
    """Lengths of lines that can be ``least`` similar to a line of ``n`` characters."""
    return range(ceil(n * least / (2 - least) - 1e-9), floor(n * (2 - least) / least + 1e-9) + 1)


@lru_cache(maxsize=100_000)
def lost_grams(n: int, q: int, least: float) -> int:
    """How many of a line's q-grams a partner can lack at most."""
    worst = 0
    for m in partner_lengths(n, least):
        matched = ceil(least * (n + m) / 2 - 1e-9)
        if matched <= min(n, m):
            worst = max(worst, q * (n - matched) + (q - 1) * (m - matched))
    return worst


@lru_cache(maxsize=64)
def long_enough(least: float, q: int = GRAM) -> int | None:
    """From this length on any two similar lines share a q-gram; None if they needn't at any length."""
    short = [n for n in range(1, 400) if n - q + 1 - lost_grams(n, q, least) < 1]
    return None if short and short[-1] > 300 else (short[-1] if short else 0) + 1


def grams(line: str, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the q-grams, the same numbered by occurrence, so that two lines' common numbers are their common grams)."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < q:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = points[: len(points) - q + 1].copy()
    for k in range(1, q):
        h = (h ^ (h >> np.uint64(29))) * _MIX + points[k : len(points) - q + 1 + k]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    order = np.argsort(h, kind="stable")
    run = np.flatnonzero(np.diff(h[order], prepend=h[order][:1] + np.uint64(1)))
    nth = np.arange(len(h)) - np.repeat(run, np.diff(run, append=len(h)))
    numbered = (h[order] + nth.astype(np.uint64)) * _MIX
    return h[order], numbered ^ (numbered >> np.uint64(30))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _schemes(n: int, least: float) -> list[int]:
    enough = long_enough(least)
    if enough is None:
        return [1]
    longest_short = partner_lengths(enough - 1, least)[-1] if enough > 1 else 0
    return [q for q, fits in ((1, n <= longest_short), (GRAM, n >= enough)) if fits]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how often each bucket of grams occurs."""
    n = {q: np.zeros(BUCKETS, np.int64) for q in (1, GRAM)}
    for b in batches:
        for line in b.column(0).to_pylist():
            for q, held in n.items():
                np.add.at(held, _bucket(grams(line, q)[0]), 1)
    rows = [(q, int(i), int(held[i])) for q, held in n.items() for i in np.flatnonzero(held)]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["q", "bucket", "n"])


def _prefixes(sent, least: float):
    """Each line's rarest grams: as many as it takes to share one with every similar line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = sent.value
        for b in batches:
            row, chars, scheme, token = [], [], [], []
            for i, line in enumerate(b.column("line").to_pylist()):
                for q in _schemes(len(line), least):
                    h, numbered = grams(line, q)
                    first = numbered[np.lexsort((numbered, rarity[q][_bucket(h)]))[: lost_grams(len(line), q, least) + 1]]
                    row += [i] * len(first)
                    chars += [len(line)] * len(first)
                    scheme += [q] * len(first)
                    token.append(first.view(np.int64))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(at), b.column("place").take(at), pa.array(chars, pa.int32()), pa.array(scheme, pa.int32()), pa.array(np.concatenate([*token, np.empty(0, np.int64)]))],
                ["doc", "place", "chars", "q", "token"],
            )

    return run


def character_places(line: str) -> dict[str, int]:
    """Per character the places where a line has it, as bits."""
    places: dict[str, int] = {}
    for k, x in enumerate(line):
        places[x] = places.get(x, 0) | 1 << k
    return places


def common_subsequence(a: str, places: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence of ``a`` and a line of ``n`` characters, given by its places (Hyyro's bits)."""
    every = (1 << n) - 1
    open_ = every
    for x in a:
        met = open_ & places.get(x, 0)
        open_ = (open_ + met | open_ - met) & every
    return n - open_.bit_count()


def rare_places(line: str) -> dict[str, list[int]] | None:
    """The places of the characters that difflib goes by in a second line; None for a short one, where it goes by all."""
    if len(line) < JUNK_FROM:
        return None
    return {x: _places(line, x) for x, n in Counter(line).items() if n <= len(line) // 100 + 1}


def _places(line: str, x: str) -> list[int]:
    at, k = [], line.find(x)
    while k >= 0:
        at.append(k)
        k = line.find(x, k + 1)
    return at


def _block(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """difflib's longest block of a short line: the first in ``a``, then in ``b``."""
    i, at, n = alo, alo, 0
    while i + n < ahi:
        if b.find(a[i : i + n + 1], blo, bhi) >= 0:
            at, n = i, n + 1
            while i + n < ahi and b.find(a[i : i + n + 1], blo, bhi) >= 0:
                n += 1
        i += 1
    return at, b.find(a[at : at + n], blo, bhi), n


def _rare_block(a: str, b: str, at: list[int], rare: dict[str, list[int]], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """difflib's longest block of a long line: the longest run of rare characters, widened while characters are equal."""
    best_i, best_j, n = alo, blo, 0
    runs: dict[int, int] = {}
    before = -2
    for x in range(bisect_left(at, alo), bisect_left(at, ahi)):
        i = at[x]
        if i != before + 1:
            runs = {}
        before, new, places = i, {}, rare[a[i]]
        for y in range(bisect_left(places, blo), bisect_left(places, bhi)):
            j = places[y]
            k = new[j] = runs.get(j - 1, 0) + 1
            if k > n:
                best_i, best_j, n = i - k + 1, j - k + 1, k
        runs = new
    while best_i > alo and best_j > blo and a[best_i - 1] == b[best_j - 1]:
        best_i, best_j, n = best_i - 1, best_j - 1, n + 1
    while best_i + n < ahi and best_j + n < bhi and a[best_i + n] == b[best_j + n]:
        n += 1
    return best_i, best_j, n


def ratio(a: str, b: str, rare: dict[str, list[int]] | None, least: float = 0.0) -> float:
    """difflib's ratio of two lines, 0 as soon as it can't reach ``least``; ``rare`` are the places of ``b``."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    at = [] if rare is None else sorted(i for x in rare for i in _places(a, x))
    matched, open_, todo = 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        open_ -= min(ahi - alo, bhi - blo)
        i, j, n = _block(a, b, alo, ahi, blo, bhi) if rare is None else _rare_block(a, b, at, rare, alo, ahi, blo, bhi)
        if n:
            matched += n
            for rest in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)):
                if rest[0] < rest[1] and rest[2] < rest[3]:
                    todo.append(rest)
                    open_ += min(rest[1] - rest[0], rest[3] - rest[2])
        if 2.0 * (matched + open_) / total < least:
            return 0.0
    return 2.0 * matched / total


def _ratios(least: float):
    """Ratio of the candidates (doc, i, j, a, b) that reach ``least``; each distinct gold line is indexed once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            held: dict[str, np.ndarray] = {}
            for line in {*a, *b}:
                held[line] = np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)
            at, reached, matcher, indexed, rare, placed, places = [], [], SequenceMatcher(None), None, None, None, {}
            for k in sorted(range(len(a)), key=b.__getitem__):
                if 2 * np.minimum(held[a[k]], held[b[k]]).sum() < least * (len(a[k]) + len(b[k])) - 1e-9:
                    continue
                if b[k] != placed:
                    placed, places = b[k], character_places(b[k])
                if 2 * common_subsequence(a[k], places, len(placed)) < least * (len(a[k]) + len(placed)) - 1e-9:
                    continue
                if b[k] != indexed:
                    indexed, rare = b[k], rare_places(b[k])
                    if rare is None:
                        matcher.set_seq2(indexed)
                if rare is None:
                    matcher.set_seq1(a[k])
                    r = matcher.ratio()
                else:
                    r = ratio(a[k], indexed, rare, least)
                if r >= least:
                    at.append(k)
                    reached.append(r)
            found = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(found) for c in ("doc", "i", "j")), pa.array(reached, pa.float64())], ["doc", "i", "j", "ratio"])

    return run


def _letters(lines: list[str]) -> np.ndarray:
    return np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64) for x in lines])


def matched_lines(predicted: list[str | None], gold: list[str | None], least: float, most: int = IN_ROW) -> int | None:
    """How many lines of a document ``line_matches`` would match; None if over ``most`` pairs are left by the equal ones.

    Pairs come in the order of what their letters allow at most.  A pair's ratio is computed when its
    turn comes, if both of its lines are free then, and it is taken once no other can come before it.
    """
    common = Counter(x for x in predicted if x is not None) & Counter(x for x in gold if x is not None)

    def left(lines: list[str | None]) -> list[str]:
        used, out = common.copy(), []
        for x in reversed(lines):  # equal lines are paired from the end
            if x is not None:
                if used[x] > 0:
                    used[x] -= 1
                else:
                    out.append(x)
        return out[::-1]

    p, g, n = left(predicted), left(gold), common.total()
    if len(p) * len(g) > most:
        return None
    if not p or not g or least == 1:
        return n
    letters, other = _letters(p), _letters(g)
    lengths, others = letters.sum(1), other.sum(1)
    step = max(1, most // (64 * len(g)))
    both = np.concatenate([np.minimum(letters[k : k + step, None], other[None]).sum(2) for k in range(0, len(p), step)])
    total = lengths[:, None] + others[None]
    i, j = np.nonzero(2.0 * both >= least * total - 1e-9)
    bound = 2.0 * both[i, j] / np.maximum(total[i, j], 1)
    free_i, free_j, rare, reached = [True] * len(p), [True] * len(g), {}, []

    def take(before: tuple | None) -> int:
        taken = 0
        while reached and (before is None or reached[0] < before):
            _, y, z = heappop(reached)
            if free_i[-y] and free_j[-z]:
                free_i[-y] = free_j[-z] = False
                taken += 1
        return taken

    for x in np.lexsort((-j, -i, -bound)).tolist():
        y, z = int(i[x]), int(j[x])
        n += take((-float(bound[x]), -y, -z))
        if free_i[y] and free_j[z]:
            if z not in rare:
                rare[z] = rare_places(g[z])
            r = ratio(p[y], g[z], rare[z], least)
            if r >= least:
                heappush(reached, (-r, -y, -z))
    return n + take(None)


def _in_rows(least: float, most: int):
    """Adds how many lines are matched to the rows (key, sizes, predicted, gold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(0).is_valid().to_pylist()
            n = [matched_lines(b.column(3)[k].as_py() or [], b.column(4)[k].as_py() or [], least, most) if known[k] else 0 for k in range(len(b))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int32())], [*b.schema.names[:3], "matched"])

    return run


def dominant_pairs(i: np.ndarray, j: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Places of the pairs that are taken, by rounds of local dominance."""
    left = np.lexsort((-j, -i, -ratio))  # in the order of taking
    taken: list[np.ndarray] = []
    while len(left):
        place = np.arange(len(left))
        first_i, first_j = (np.isin(place, np.unique(x[left], return_index=True)[1]) for x in (i, j))
        now = left[first_i & first_j]
        taken.append(now)
        left = left[~(np.isin(i[left], i[now]) | np.isin(j[left], j[now]))]
    return np.concatenate([*taken, np.empty(0, np.int64)]).astype(np.int64)


def tasks(spark: SparkSession) -> int:
    """Tasks for work that takes long for its bytes: adaptive execution would put it into as few as hold these."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _decide(pairs: DataFrame, in_task: int) -> list[DataFrame]:
    """The pairs (doc, i, j, ratio) that are taken, as tables."""
    kind = dict(pairs.dtypes)["doc"]

    def small(rows: pd.DataFrame) -> pd.DataFrame:
        """The pairs of some documents: their lines are numbered through, which keeps the order in each."""
        doc = pd.factorize(rows["doc"])[0].astype(np.int64) << 32
        i, j = (np.unique(doc + rows[c].to_numpy(), return_inverse=True)[1] for c in "ij")
        return rows.iloc[dominant_pairs(i, j, rows["ratio"].to_numpy())][["doc", "i", "j", "ratio"]]

    out: list[DataFrame] = []
    while True:
        per = stored(pairs.groupBy("doc").agg(F.count("*").alias("n"), (F.count("*") > in_task).alias("large")), "match-sizes")
        few = pairs.join(per.where("not large"), "doc", "left_semi")
        held = per.where("not large").agg(F.sum("n")).first()[0] or 0
        groups = max(tasks(pairs.sparkSession), -(-2 * held // IN_TASK))
        together = few.withColumn("some", F.pmod(F.xxhash64("doc"), F.lit(groups))).groupBy("some").applyInPandas(small, f"doc {kind}, i int, j int, ratio double")
        out.append(stored(together, "matched"))
        if per.where("large").isEmpty():
            return out
        rank = F.struct("ratio", "i", "j")
        over_i, over_j = Window.partitionBy("doc", "i"), Window.partitionBy("doc", "j")
        best = pairs.join(per.where("large"), "doc", "left_semi").withColumn("best", F.max(rank).over(over_i) == rank).withColumn("best", F.col("best") & (F.max(rank).over(over_j) == rank))
        used = best.withColumn("used", F.max("best").over(over_i)).withColumn("used", F.col("used") | F.max("best").over(over_j))
        done = stored(used, "match-round")
        out.append(done.where("best").select("doc", "i", "j", "ratio"))
        pairs = done.where("not used").select("doc", "i", "j", "ratio")


def _equal_lines(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Equal lines of a document, paired by their ranks from the end: doc, i, j, ratio."""
    last = Window.partitionBy("doc", "line").orderBy(F.desc("place"))
    p, g = (x.withColumn("nth", F.row_number().over(last)).withColumnRenamed("place", c) for x, c in ((predicted, "i"), (gold, "j")))
    return p.join(g, ["doc", "line", "nth"]).select("doc", "i", "j", F.lit(1.0).alias("ratio"))


def line_matches(predicted: DataFrame, gold: DataFrame, least: float = 0.85, rungs: tuple[float, ...] = RUNGS, in_task: int = IN_TASK) -> DataFrame:
    """doc, i, j, ratio of the matched lines of ``predicted`` and ``gold`` (doc, place int, line), ratio at least ``least``.

    Lines without a document, and null lines, match nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity lies over 0, up to 1")
    spark = predicted.sparkSession
    ship(spark)
    tables = [stored(x.select("doc", F.col("place").cast("int").alias("place"), "line").where("doc is not null and line is not null"), "match-lines") for x in (predicted, gold)]
    kind = dict(tables[0].dtypes)["doc"]
    found = [stored(_equal_lines(*tables), "matched")]
    if least == 1:
        return found[0]
    left = lambda used: [stored(x.join(used, [x["doc"] == used["doc"], x["place"] == used[c]], "left_anti").repartition(tasks(spark)), "match-lines") for x, c in zip(tables, "ij", strict=True)]
    tables = left(found[0])

    rarity = {q: np.zeros(BUCKETS, np.int64) for q in (1, GRAM)}
    for r in tables[0].select("line").unionByName(tables[1].select("line")).mapInArrow(_counts, "q int, bucket int, n bigint").groupBy("q", "bucket").agg(F.sum("n").alias("n")).collect():
        rarity[r["q"]][r["bucket"]] = r["n"]  # 2 * BUCKETS numbers at most
    sent = spark.sparkContext.broadcast(rarity)
    for rung in [*(r for r in sorted(rungs, reverse=True) if r > least), least]:
        shape = f"doc {kind}, place int, chars int, q int, token bigint"
        p, g = (x.mapInArrow(_prefixes(sent, rung), shape).select("doc", "q", "token", F.col("place").alias(c), F.col("chars").alias(f"chars_{c}")) for x, c in zip(tables, "ij", strict=True))
        reach = F.least("chars_i", "chars_j") * 2 >= F.lit(rung - 1e-9) * (F.col("chars_i") + F.col("chars_j"))
        candidates = p.join(g, ["doc", "q", "token"]).where(reach).select("doc", "i", "j").distinct()
        texts = candidates.join(tables[0].select("doc", F.col("place").alias("i"), F.col("line").alias("a")), ["doc", "i"]).join(tables[1].select("doc", F.col("place").alias("j"), F.col("line").alias("b")), ["doc", "j"])
        dealt = texts.select("doc", "i", "j", "a", "b").repartition(tasks(spark), "doc", "j")  # pairs of a gold line stay together
        pairs = stored(dealt.mapInArrow(_ratios(rung), f"doc {kind}, i int, j int, ratio double"), "match-pairs")
        now = _decide(pairs, in_task)
        found += now
        if rung > least:
            used = now[0]
            for x in now[1:]:
                used = used.unionByName(x)
            tables = left(used)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def match_clauses(pairs: DataFrame, key: str, least: float = 0.85, in_row: int = IN_ROW) -> DataFrame:
    """key, n_predicted, n_gold, matched per document (key, predicted array, gold array); a document is one row."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity lies over 0, up to 1")
    ship(pairs.sparkSession)
    sizes = (F.size("predicted").alias("n_predicted"), F.size("gold").alias("n_gold"))
    kind = dict(pairs.dtypes)[key]
    done = stored(pairs.select(key, *sizes, "predicted", "gold").mapInArrow(_in_rows(least, in_row), f"`{key}` {kind}, n_predicted int, n_gold int, matched int"), "matched-rows")
    large = done.where("matched is null")
    if large.isEmpty():
        return done
    rest = pairs.join(large.select(key), key, "left_semi")
    lines = [rest.select(F.col(key).alias("doc"), F.posexplode(c).alias("place", "line")) for c in ("predicted", "gold")]
    n = line_matches(*lines, least).groupBy("doc").agg(F.count("*").cast("int").alias("n"))
    counted = large.join(n, F.col(key) == F.col("doc"), "left").select(key, "n_predicted", "n_gold", F.coalesce("n", F.lit(0)).alias("matched"))
    return done.where("matched is not null").unionByName(counted)
