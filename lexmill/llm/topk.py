"""Exact top-k search by columnar branch-and-bound.

Candidates stand in vertical layout: one row of a matrix per dimension.  The
inner products of a slab of queries are accumulated dimension block by dimension
block.  After a block the rest of a product is at most the product of the norms
that remain in the dimensions still to come (remaining mass), which gives every
candidate an upper and a lower bound; candidates whose upper bound is under the
k-th best lower bound are dropped, and the survivors' columns are compacted before
the next block.  What is left at the end has exact scores.  A task takes its candidates
in chunks, and the k-th best score of the chunks so far bounds the next ones too.

Components are integers (floor(64 * x) by default).  Products are exact in
float64 while sums stay under 2**53; slabs whose norms could pass that are scored
with Python integers and clipped to the range of a long.

Queries go to the tasks in slabs of at most ``slab`` vectors, a fixed size, one
after the other; each candidate partition answers with at most k rows per query,
packed in one row, and a window over the query picks the final k.

Defined cases: vectors that are null or hold null or non-finite components take no part;
of vectors of different lengths the components that both have are multiplied; ties go to
the smaller id; the answers to queries that share an id are merged; every candidate with the query's own id is left out; repeated rows of
another id each take a rank; fewer than k candidates give fewer rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import small_batches

SLAB, BLOCK, CHUNK = 8192, 16, 4096
_EXACT = 2.0**52


def whole_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) as doubles, usable rows only."""
    x = F.col("embedding")
    usable = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return vectors.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda e: e.cast("double")).alias("x")).select(
        "vec_id", F.transform("x", lambda e: F.floor(F.lit(scale) * e).cast("double")).alias("v")
    )


def suffix_norms(m: np.ndarray, block: int) -> np.ndarray:
    """Norm of what remains from each block on; a row per block and one of zeros.  ``m`` is (dims, n)."""
    dims, n = m.shape
    starts = list(range(0, dims, block))
    out = np.zeros((len(starts) + 1, n))
    for i in range(len(starts) - 1, -1, -1):
        part = m[starts[i] : starts[i] + block]
        out[i] = out[i + 1] + (part * part).sum(0)
    return np.sqrt(out) * (1 + 1e-12)


def bounded_search(queries: np.ndarray, query_ids: np.ndarray, cand: np.ndarray, cand_ids: np.ndarray, k: int, block: int = BLOCK, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (row) the ids and scores of its k best candidates (columns of ``cand``), but those under ``least``."""
    dims = cand.shape[0]
    starts = list(range(0, dims, block))
    q_rest, c_rest = suffix_norms(np.ascontiguousarray(queries.T), block), suffix_norms(cand, block)
    found = []
    for lo in range(0, len(queries), 64):
        q = queries[lo : lo + 64]
        first = q[:, :block] @ cand[:block]
        for i in range(len(q)):
            live = np.flatnonzero(cand_ids != query_ids[lo + i]) if k else np.empty(0, int)
            partial = first[i][live]
            for b in range(1, len(starts) + 1):
                room = q_rest[b, lo + i] * c_rest[b][live]
                floor = -np.inf if least is None else least[lo + i]
                if len(live) > k:
                    floor = max(floor, np.partition(partial - room, len(live) - k)[len(live) - k])
                if floor > -np.inf:
                    stay = partial + room >= floor - 1e-6
                    live, partial = live[stay], partial[stay]
                if b < len(starts):
                    part = slice(starts[b], starts[b] + block)
                    partial = partial + q[i, part] @ cand[part][:, live]
            order = np.lexsort((cand_ids[live], -partial))[:k]
            found.append((cand_ids[live][order], partial[order]))
    return found


def _whole_search(queries: np.ndarray, query_ids: np.ndarray, cand: np.ndarray, cand_ids: np.ndarray, k: int) -> list[tuple[list[int], list[int]]]:
    """The same in unbounded integers, for components too large for float64 sums."""
    columns = [[int(x) for x in c] for c in cand.T]
    found = []
    for q, own in zip(queries, query_ids, strict=True):
        whole = [int(x) for x in q]
        scored = sorted((-sum(a * b for a, b in zip(whole, c, strict=True)), int(i)) for c, i in zip(columns, cand_ids, strict=True) if i != own)[:k]
        found.append(([i for _, i in scored], [max(-(2**63), min(2**63 - 1, -s)) for s, _ in scored]))
    return found


def _search(slab, k: int, block: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = slab.value
        dims = queries.shape[1]
        best: dict[int, tuple[list, list]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def work() -> None:
            cand_ids = np.concatenate([h[0] for h in held])
            cand = np.ascontiguousarray(np.concatenate([h[1] for h in held]).T)
            top = np.sqrt(max((queries * queries).sum(1).max(initial=0), (cand * cand).sum(0).max(initial=0)))
            least = np.array([best[i][1][-1] if len(best.get(i, ([], []))[1]) == k else -np.inf for i in range(len(queries))], float) if k else None
            exact = top * top < _EXACT
            found = bounded_search(queries, query_ids, cand, cand_ids, k, block, least) if exact else _whole_search(queries, query_ids, cand, cand_ids, k)
            for i, (got_ids, got) in enumerate(found):
                old_ids, old = best.get(i, ([], []))
                merged = sorted(zip([-int(x) for x in got] + [-x for x in old], [int(x) for x in got_ids] + old_ids, strict=True))[:k]
                best[i] = ([x for _, x in merged], [-s for s, _ in merged])
            held.clear()

        for b in batches:
            values = b.column(1)
            m = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if len(b) else np.empty((0, dims))
            held.append((b.column(0).to_numpy(), m))
            rows += len(b)
            if rows >= chunk:
                work()
                rows = 0
        if rows:
            work()
        pairs = [(int(query_ids[i]), i) for i in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([q for q, _ in pairs], pa.int64()), pa.array([best[i][0] for _, i in pairs], pa.list_(pa.int64())), pa.array([best[i][1] for _, i in pairs], pa.list_(pa.int64()))],
            ["query_id", "ids", "scores"],
        )

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, slab: int = SLAB, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best for each row that ``is_query`` (a Column) holds for."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    whole = whole_vectors(vectors, scale)
    n_queries, dims, shortest = whole.agg(F.count_if(is_query), F.max(F.when(is_query, F.size("v"))), F.min(F.size("v"))).first()
    dims = max(1, dims or 0)
    # Components that no query has count for nothing; those that a vector lacks count as 0.
    whole = whole.withColumn("v", F.slice("v", 1, dims))
    if shortest is not None and shortest < dims:
        whole = whole.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v"))))
    queries = whole.where(is_query)
    n_slabs = max(1, math.ceil(n_queries / slab * 1.25))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(n_slabs))
    out = None
    for s in range(n_slabs):
        rows = queries.where(part == s).dropDuplicates(["vec_id", "v"]).orderBy("vec_id", "v").toArrow()  # about ``slab`` rows
        ids = np.array(rows.column("vec_id").to_pylist(), np.int64)
        if len(ids):
            matrix = np.array(rows.column("v").to_pylist(), float).reshape(len(ids), dims)
            sent = spark.sparkContext.broadcast((ids, matrix))
            found = whole.mapInArrow(_search(sent, k, block, chunk), "query_id bigint, ids array<bigint>, scores array<bigint>")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, ids array<bigint>, scores array<bigint>")
    flat = out.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
