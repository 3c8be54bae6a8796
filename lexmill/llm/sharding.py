"""Sharding: minimax contiguous partition over ordered groups of equal texts.

All of it is DataFrame code.  Groups of equal texts are atomic and ordered by the first
KEY_BITS bits of the SHA-256 of their text.  The line of groups is summed into cells (the
groups that share the leading CELL_BITS bits), whose sums the driver sees.  A binary
search finds the smallest capacity for which greedy filling needs no more than the given
number of shards.  A cell can be cut inside as long as it holds more than one group, so
this bounds the least capacity of the groups from both sides; the cells in which a cut
can lie under these bounds, and those of an eighth of a shard or more, are then split by
STEP_BITS more bits, and the search runs again, until only single groups stand where a
cut can lie.  The capacity is then the least there is.  A
round reads the groups' sums once and sends the driver some thousands of numbers.

Greedy filling would leave all slack to the last shards.  A second search finds the largest
size that the smallest shard can have under that capacity with no shard empty, and of the cuts
that keep both bounds those nearest to even shares are taken.

A group larger than an even share can't be balanced without tearing equal texts
apart: such giants (fewer than ``n_shards`` can exist) get a shard of their own
and the other groups are cut over the shards that are left.

Defined cases: a null text counts as the empty text; null ids take part like
others; equal rows are separate rows of one group; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialize, text_or_empty

ROW_BYTES = 16
KEY_BITS, CELL_BITS, STEP_BITS = 60, 16, 6
#: Rows that are numbered together, on average.
SLOT_ROWS = 100_000


class Cell(NamedTuple):
    """The groups whose keys begin with the ``bits`` bits ``prefix``."""

    prefix: int
    bits: int
    bytes: int
    groups: int

    @property
    def last_key(self) -> int:
        return ((self.prefix + 1) << (KEY_BITS - self.bits)) - 1

    @property
    def divisible(self) -> bool:
        return self.groups > 1 and self.bits < KEY_BITS


def greedy_cuts(ends: list[int], capacity: int) -> list[int]:
    """Cell counts at which greedy filling closes a shard; ``ends`` are running sums."""
    cuts, start, base = [], 0, 0
    while start < len(ends):
        stop = bisect_right(ends, base + capacity)
        if stop == start:
            raise ValueError("a cell is larger than the capacity")
        cuts.append(stop)
        start, base = stop, ends[stop - 1]
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cuts of the contiguous partition into ``shards`` parts with the least largest part.

    The binary search runs over capacities; each is checked by filling greedily.
    """
    if not sizes:
        return []
    ends = list(accumulate(sizes))
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if len(greedy_cuts(ends, mid)) <= shards:
            high = mid
        else:
            low = mid + 1
    return greedy_cuts(ends, low)


def level_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cuts with the least largest part and, under that, the largest smallest part, as near to even shares as these allow.

    With fewer sizes than shards each has a part of its own.  For each number of parts the ends that
    they can have are marked, over all ends at once; the search over the smallest part asks whether the last end is marked.
    """
    if not sizes:
        return []
    greedy = minimax_cuts(sizes, shards)
    parts = min(shards, len(sizes))
    ends = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
    largest = max(int(ends[b] - ends[a]) for a, b in zip([0, *greedy], greedy, strict=False))
    total, at = int(ends[-1]), np.arange(len(ends))
    first = np.searchsorted(ends, ends - largest, "left")

    def marked(smallest: int) -> list[np.ndarray] | None:
        last = np.minimum(np.searchsorted(ends, ends - smallest, "right"), at)  # no part is empty
        found, open_ = [], at == 0
        for _ in range(parts):
            before = np.concatenate([[0], np.cumsum(open_)])
            open_ = before[np.maximum(first, last)] > before[first]
            found.append(np.packbits(open_))
        return found if open_[-1] else None

    low, high = 0, total // parts
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if marked(mid) else (low, mid - 1)
    found = marked(low)
    cuts = [len(sizes)]
    for i in range(parts - 1, 0, -1):
        end = ends[cuts[0]]
        can = np.flatnonzero(np.unpackbits(found[i - 1])[: len(ends)])
        can = can[(ends[can] >= end - largest) & (ends[can] <= end - low) & (can < cuts[0])]
        cuts.insert(0, int(can[np.argmin(np.abs(ends[can] * parts - i * total))]))
    return cuts


def _reach(cells: list[Cell], ends: list[int], capacity: int, shards: int, into: bool) -> list[int]:
    """The cell at which each greedy cut of ``capacity`` comes to stand: at the earliest, or (``into``) at the latest.

    Groups are cut at least as late as whole cells, and at most as late as if a divisible
    cell could be cut anywhere.
    """
    out, base = [], 0
    for _ in range(shards):
        stop = bisect_right(ends, base + capacity)
        out.append(min(stop, len(cells) - 1))
        if stop < len(cells) and into and cells[stop].divisible:
            base += capacity
        else:
            base = max(base, ends[stop - 1] if stop else 0)
    return out


def open_cells(cells: list[Cell], shards: int) -> tuple[int, set[int]]:
    """(least capacity over cells, the divisible cells in which a cut of the groups' least capacity can lie)."""
    sizes = [c.bytes for c in cells]
    ends = list(accumulate(sizes))
    cuts = minimax_cuts(sizes, shards)
    high = max(ends[b - 1] - (ends[a - 1] if a else 0) for a, b in zip([0, *cuts], cuts, strict=False))
    slack = max((c.bytes for c in cells if c.divisible), default=0)
    while True:
        # Moving every cut to the end of its cell adds ``slack`` at most, so the groups need high - slack at least.
        first, last = _reach(cells, ends, high - slack, shards, into=False), _reach(cells, ends, high, shards, into=True)
        found = {i for a, b in zip(first, last, strict=True) for i in range(a, b + 1) if cells[i].divisible}
        now = max((cells[i].bytes for i in found), default=0)
        if now >= slack:
            return high, found
        slack = now


def _cells(groups: DataFrame, bits: int) -> list[Cell]:
    prefix = F.shiftright("key", KEY_BITS - bits).alias("prefix")
    found = groups.groupBy(prefix).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups")).collect()
    return [Cell(r["prefix"], bits, r["bytes"], r["groups"]) for r in found]


def minimax_cells(groups: DataFrame, shards: int) -> list[int]:
    """Last keys of the shards of the partition of ``groups`` (key, bytes) with the least largest shard."""
    spark = groups.sparkSession
    cells = sorted(_cells(groups, CELL_BITS), key=lambda c: c.last_key)  # 2 ** CELL_BITS at most
    total = sum(c.bytes for c in cells)
    while cells:
        _, found = open_cells(cells, shards)
        if not found:
            break
        found |= {i for i, c in enumerate(cells) if c.divisible and 8 * shards * c.bytes > total}
        finer: list[Cell] = []
        for bits in sorted({cells[i].bits for i in found}):
            asked = spark.createDataFrame([(cells[i].prefix,) for i in found if cells[i].bits == bits], "prefix bigint")
            inside = groups.join(F.broadcast(asked), F.shiftright("key", KEY_BITS - bits) == F.col("prefix"), "left_semi")
            finer += _cells(inside, min(KEY_BITS, bits + STEP_BITS))
        cells = sorted([c for i, c in enumerate(cells) if i not in found] + finer, key=lambda c: c.last_key)
    return [cells[c - 1].last_key for c in level_cuts([c.bytes for c in cells], shards)]


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    law is ``bytes``: the largest shard is as small as contiguous cuts between groups of
    equal texts allow, and then the smallest as large.  ``slot`` numbers a shard's rows from 0 without gaps; it is counted
    per (shard, hash bucket) and shifted by the counts of the buckets before, so no task
    holds a whole shard.
    """
    text = text_or_empty()
    digest = F.sha2(text, 256)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        digest.alias("digest"),
    )
    rows = materialize(rows, "shard-rows").withColumn("key", F.conv(F.substring("digest", 1, KEY_BITS // 4), 16, 10).cast("bigint"))
    groups = materialize(rows.groupBy("digest", "key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")

    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    giants = groups.where(F.col("bytes") * n_shards > total).orderBy("digest").collect()  # fewer than n_shards of them can exceed total / n_shards
    giant_of = {g["digest"]: i for i, g in enumerate(giants[: n_shards - 1])}
    rest = groups.where(~F.col("digest").isin(list(giant_of))) if giant_of else groups
    last_keys = minimax_cells(rest.select("key", "bytes"), n_shards - len(giant_of))

    shard = F.lit(len(giant_of) + len(last_keys) - 1)
    for i in range(len(last_keys) - 2, -1, -1):
        shard = F.when(F.col("key") <= last_keys[i], len(giant_of) + i).otherwise(shard)
    for digest, i in giant_of.items():
        shard = F.when(F.col("digest") == digest, i).otherwise(shard)

    slot_buckets = max(64, n_rows // (n_shards * SLOT_ROWS))
    placed = rows.select(
        "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slot_buckets)).alias("bucket"),
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )  # n_shards * 64 rows, or one per SLOT_ROWS
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") + F.col("offset")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
