"""Vector code compression: product codes, found by partial-distance search.

Vectors become integers (floor(scale * x)) and are cut into equal consecutive parts; every
part is coded by the index of the nearest entry of its part's codebook.  Codebooks start as
the parts of the vectors with the smallest ids and are moved by rounds of assignment and
averaging, all in whole numbers, so that tasks can be split and repeated in any way without
changing a bit.

Partial-distance search: dimensions are processed in descending variance of the codebook.
After the first few the entry that is ahead is completed, which gives the best complete
distance so far; vectorised masks drop every (vector, entry) pair whose accumulated distance
is strictly over it, the pairs left go on to the next dimensions, and the bound is completed
anew after each step.  Entries at an equal distance are never dropped, so ties go to the lower index.

A round is one pass over the integer vectors: tasks add up their vectors per entry and send
``parts * entries`` sums at most; Spark merges them, and the driver sees the codebooks only
(entries * dimensions numbers, however many vectors there are).

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter
vectors are filled up with 0 to the longest length, and if that isn't divisible by ``parts`` the
parts differ by one; components from 2**40 on count as 2**40; distances over a long count as the
longest; a null id is coded like others but comes last for the start; repeated ids are rows of
their own, ordered by their components; with fewer vectors than entries the codebooks are smaller;
labels may be null and then belong together; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialize, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Dimensions per step of the search; (vector, entry) pairs held at once.
STEP, PAIRS = 4, 1 << 20
LONGEST, _LONG = 1 << 40, (1 << 63) - 1
#: Buckets that a label's rows are dealt over when they meet their sum.
DEALT = 32


def distances_fit(points: np.ndarray, book: np.ndarray) -> bool:
    """Whether all squared distances stay within 62 bits."""
    far = int(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0))) * 2
    return far * far * max(1, points.shape[1]) < 1 << 62


def nearest(points: np.ndarray, book: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (a row of ``book``) of each point, and the squared distance."""
    if not distances_fit(points, book):
        points, book = points.astype(object), book.astype(object)
    order = np.argsort(-np.var(book.astype(float), axis=0), kind="stable")
    points, book = points[:, order], book[:, order]
    n, dims = points.shape
    index, distance = np.empty(n, np.int64), np.empty(n, points.dtype)
    rows_at_once = max(1, PAIRS // max(1, len(book)))
    for lo in range(0, n, rows_at_once):
        p = points[lo : lo + rows_at_once]
        entry, best = _search(p, book, dims, step)
        index[lo : lo + len(p)], distance[lo : lo + len(p)] = entry, best
    return index, distance


def _search(p: np.ndarray, book: np.ndarray, dims: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    ahead = np.zeros((len(p), len(book)), p.dtype)
    for d in range(min(step, dims)):
        gap = p[:, d, None] - book[None, :, d]
        ahead += gap * gap
    first = ahead.argmin(1)
    gap = p - book[first]
    limit = (gap * gap).sum(1)
    row, entry = np.nonzero(ahead <= limit[:, None])
    ahead = ahead[row, entry]
    for d in range(step, dims, step):
        gap = p[row, d : d + step] - book[entry, d : d + step]
        ahead = ahead + (gap * gap).sum(1)
        live = ahead <= limit[row]
        row, entry, ahead = row[live], entry[live], ahead[live]
        if d + step < dims:
            leader = entry[_firsts(row, ahead)]
            gap = p - book[leader]
            limit = np.minimum(limit, (gap * gap).sum(1))
    at = _firsts(row, ahead)
    return entry[at], ahead[at]


def _firsts(row: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Place of the least value of each row, the first of equal ones; rows ascend and none is missing."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(ahead, starts) if len(starts) else ahead
    places = np.flatnonzero(ahead == least[row])
    return places[np.flatnonzero(np.diff(row[places], prepend=-1))]


def part_bounds(dims: int, parts: int) -> list[tuple[int, int]]:
    return [(dims * p // parts, dims * (p + 1) // parts) for p in range(parts)]


def whole_vectors(vectors: DataFrame, scale: float, carried: tuple[str, ...]) -> DataFrame:
    """vec_id, carried columns, v: the integer components of the usable rows."""
    x = F.col("embedding")
    usable = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    whole = lambda e: F.floor(F.greatest(F.least(F.lit(scale) * e.cast("double"), F.lit(float(LONGEST))), F.lit(-float(LONGEST))))
    return vectors.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), *carried, F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The lists of a column as rows, filled up with 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _sums(sent, bounds: list[tuple[int, int]], dims: int):
    """Per task: part, entry, vectors, and their sums as high and low 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        counts = [np.zeros(len(b), np.int64) for b in books]
        high, low = ([np.zeros(b.shape, np.int64) for b in books] for _ in range(2))
        for batch in batches:
            m = _matrix(batch.column(0), dims)
            for p, (a, z) in enumerate(bounds):
                entry, _ = nearest(m[:, a:z], books[p])
                order = np.argsort(entry, kind="stable")
                found, starts = np.unique(entry[order], return_index=True)
                if not len(found):
                    continue
                counts[p][found] += np.diff(starts, append=len(entry))
                if z > a:
                    total = low[p][found] + np.add.reduceat(m[order, a:z], starts, axis=0)  # a batch's sum fits: 2**40 times its rows
                    high[p][found] += total >> 32
                    low[p][found] = total & 0xFFFFFFFF
        rows = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in rows], pa.int32()), pa.array([e for _, e in rows], pa.int32()), pa.array([counts[p][e] for p, e in rows], pa.int64()),
                pa.array([high[p][e].tolist() for p, e in rows], pa.list_(pa.int64())), pa.array([low[p][e].tolist() for p, e in rows], pa.list_(pa.int64())),
            ],
            ["part", "entry", "n", "high", "low"],
        )

    return run


def moved(books: list[np.ndarray], whole: DataFrame, bounds: list[tuple[int, int]], dims: int) -> list[np.ndarray]:
    """The codebooks after a round: each entry at the floor of its vectors' mean, unused ones where they were."""
    sent = whole.sparkSession.sparkContext.broadcast(books)
    sums = whole.select("v").mapInArrow(_sums(sent, bounds, dims), "part int, entry int, n bigint, high array<bigint>, low array<bigint>")
    flat = sums.select("part", "entry", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "x"))
    total = flat.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x.high").alias("high"), F.sum("x.low").alias("low"))
    mean = total.groupBy("part", "entry").agg(F.array_sort(F.collect_list(F.struct("at", "n", "high", "low"))).alias("total"))
    out = [b.copy() for b in books]
    for r in mean.collect():  # parts * entries rows at most
        out[r["part"]][r["entry"]] = [((t["high"] << 32) + t["low"]) // t["n"] for t in r["total"]]
    sent.unpersist()
    return out


def train_codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part after ``rounds`` rounds over all of ``whole`` (vec_id, v)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    dims = whole.agg(F.max(F.size("v"))).first()[0] or 0
    bounds = part_bounds(dims, parts)
    first = whole.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    start = np.zeros((len(first), dims), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["v"])] = r["v"]
    books = [start[:, a:z].copy() for a, z in bounds]
    for _ in range(rounds if first else 0):
        books = moved(books, whole, bounds, dims)
    return books


def codebook_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def _codes(sent, bounds: list[tuple[int, int]], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            m = _matrix(batch.column(0), dims)
            found = [nearest(m[:, a:z], books[p]) for p, (a, z) in enumerate(bounds)]
            error = [min(_LONG, sum(int(x) for x in d)) for d in zip(*(d for _, d in found), strict=True)]
            code = ["".join(f"{e:02x}" for e in es) for es in zip(*(e.tolist() for e, _ in found), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(code, pa.string()), pa.array(error, pa.int64())], [*batch.schema.names[1:], "code", "error"])

    return run


def encode(whole: DataFrame, books: list[np.ndarray], carried: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, carried columns, code, error of every row of ``whole``."""
    dims = sum(b.shape[1] for b in books)
    sent = whole.sparkSession.sparkContext.broadcast(books)
    kinds = dict(whole.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("vec_id", *carried))
    return whole.select("v", "vec_id", *carried).mapInArrow(_codes(sent, part_bounds(dims, len(books)), dims), f"{schema}, code string, error bigint")


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, v: the integer vector that a code stands for."""
    tables = [F.array(*(F.array(*(F.lit(int(x)) for x in e)) for e in b)) for b in books]
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.select("vec_id", F.concat(*(F.get(t, entry(p)) for p, t in enumerate(tables))).alias("v"))


def code_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over the rows with the same label), codebooks_sha256."""
    small_batches(vectors.sparkSession, 4096)
    whole = materialize(whole_vectors(vectors, scale, ("label",)), "code-vectors")
    books = train_codebooks(whole, parts, entries, rounds)
    deal = F.pmod(F.xxhash64("vec_id", "code"), F.lit(DEALT))
    coded = materialize(encode(whole, books, ("label",)), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("bigint")
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    rows, sums = coded.withColumn("deal", deal).alias("c"), sums.alias("s")
    met = rows.join(sums, F.col("c.label").eqNullSafe(F.col("s.label")) & (F.col("c.deal") == F.col("s.deal")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
