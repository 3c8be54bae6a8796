"""MinHash near-duplicates by an LSH forest.

A document's set is its distinct word shingles, as 64-bit hashes.  Documents with
equal sets are one node (the smallest id stands for it).  A node's signature has
``TREES * DEPTH`` MinHash values; each tree reads its own run of values, and its
sorted order brings nodes with long common prefixes together.  A region is the
nodes that share a tree's first ``MIN_DEPTH`` values; a region of more than
``REGION`` nodes is read deeper, value by value, until its parts are small, so
depth adapts to how crowded a place is.  Within a region the signatures tell which
pairs can reach the threshold (less SIGMAS standard errors), and those are confirmed
on the full sets, nearest first, skipping pairs that are joined already: a region
yields a star for each of its connected parts.  A pair is looked at in the first
tree that brings it together.

Crowded regions can hide a link between parts.  After the components of the first
round are known, the nodes of all crowded regions with more than one component are
gone through again, by an exact prefix-filtered join: sets that reach the threshold
share one of their first shingles, rarest first (by counts in a table of fixed size).
All pairs of different components that share one, and whose sizes and places of it
allow the threshold, are confirmed on the full sets; a frequent shingle's rows are
compared in tiles, spread over tasks.  The second round misses no link of these nodes.

Components come from alternating large-star and small-star steps over the links.
No link, component or set is collected; what is kept between steps are tables in the
shared folder.  Texts aren't shuffled: a sieve of fixed size picks the documents whose
sets are needed.

Recall, for ideal MinHash values: a pair at similarity s shares a region with probability
1 - (1 - s**MIN_DEPTH)**TREES (more than 1 - 1e-6 at 0.85, more than 1 - 1e-4 at 0.8), and
passes the signature test of a region of REGION nodes or fewer with more than 1 - 4e-6.  In
a crowded region neither depth nor signatures lose a link, as the second round is exact.

Defined cases: a text without words (or null) has the empty set and is linked with
nothing; a text with fewer words than a shingle has one shingle, all its words;
rows that share an id are one node where their texts agree; a null id takes no
part (component null, kept); an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sieve import Sieve, may_hold
from .workspace import materialize, small_batches, unused

TREES, DEPTH, MIN_DEPTH, REGION = 16, 8, 3, 128
SIGMAS = 4.5
COUNTERS = 1 << 20
VALUES = TREES * DEPTH
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = (np.random.default_rng(20240101).integers(0, 2**63, VALUES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


#: Rows that a task may take of the small tables between steps, and the least number of tasks.
TASK_ROWS, TASKS = 250_000, 16


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which a shuffle made and which has ``rows`` rows at most, in as many tasks as they need."""
    return df.coalesce(max(TASKS, rows // TASK_ROWS))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MUL
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; A-Z are lower-cased, words part at ASCII white space."""
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(h))
    acc = np.full(len(h) - size + 1, np.uint64(size if size < words else 0))
    for i in range(size):
        acc = acc * _ODD + h[i : len(h) - size + 1 + i]
    return np.unique(_mix(acc))


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 16 bits; the permutations are multiplications by odd numbers."""
    least = np.full(VALUES, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (_SEEDS[:, None] * shingles[None, at : at + 1024]).min(1))
    return (_mix(least) >> np.uint64(48)).astype(">u2")


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                n, high, low, sig = [], [], [], []
                for text in b.column(1).to_pylist():
                    s = shingle_set(text, words)
                    n.append(len(s))
                    high.append(int(_mix(s ^ _ODD).sum(dtype=np.uint64).astype(np.int64)))
                    low.append(int((s * s * _ODD + s).sum(dtype=np.uint64).astype(np.int64)))
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, high, low)), pa.array(sig, pa.binary())], ["doc_id", "n", "high", "low", "sig"])

    return run


def _sets(words: int, wanted):
    """Sets of the documents that the sieve ``wanted`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                b = b.filter(pc.is_valid(b.column(0)))
                b = b.filter(pa.array(may_hold(wanted.value, b.column(0).to_numpy())))
                sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
                high = [int(_mix(s ^ _ODD).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(high, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "high", "shingles"])

    return run


def likely_pairs(sig: np.ndarray, tree: int, crowded: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(-equal values, i, j) of the pairs of a region that can reach the threshold.

    Pairs that an earlier tree brings together, in a region that isn't crowded, are left to it.
    """
    out = []
    for i in range(len(sig) - 1):
        equal = sig[i + 1 :] == sig[i]
        n = equal.sum(1)
        where = np.flatnonzero(n >= least)
        if not len(where):
            continue
        if tree:
            shared = equal[where].reshape(-1, TREES, DEPTH)[:, :tree, :MIN_DEPTH].all(2)
            open_trees = (crowded[i] >> np.arange(tree)) & 1 == 0
            where = where[~(shared & open_trees).any(1)]
        out += [(-int(n[j]), i, i + 1 + int(j)) for j in where]
    return out


class _Groups:
    """Splits sorted batches into runs of equal first column; a run may go on in the next batch."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.batches = batches

    def __iter__(self) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in self.batches:
            if not len(b):
                continue
            keys = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            if held and held[0].column(0)[0].as_py() != int(keys[0]):
                yield pa.Table.from_batches(held)
                held = []
            for start, stop in zip(cuts, cuts[1:], strict=False):
                held.append(b.slice(start, stop - start))
                if stop < len(keys):
                    yield pa.Table.from_batches(held)
                    held = []
        if held:
            yield pa.Table.from_batches(held)


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), ">u2").reshape(-1, VALUES)


def _needed(least: float):
    """Rows of a region that are in a likely pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _Groups(batches):
            if g.num_rows < 2:
                continue
            pairs = likely_pairs(_matrix(g.column("sig").to_pylist()), g.column("tree")[0].as_py(), g.column("crowded").to_numpy(), least)
            if pairs:
                rows = sorted({x for p in pairs for x in p[1:]})
                yield from g.take(pa.array(rows)).combine_chunks().to_batches()

    return run


def _confirmed(least: float, num: int, den: int):
    """The parts of a region that links confirmed on the full sets hold together, as (smallest node, other node); num / den is the least similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _Groups(batches):
            if g.num_rows < 2:
                continue
            nodes = g.column("node").to_numpy()
            raw = g.column("shingles").to_pylist()
            pairs = likely_pairs(_matrix(g.column("sig").to_pylist()), g.column("tree")[0].as_py(), g.column("crowded").to_numpy(), least)
            root = list(range(len(nodes)))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for _, i, j in sorted(pairs):
                x, y = find(i), find(j)
                if x == y:
                    continue
                p, q = np.frombuffer(raw[i], np.uint64), np.frombuffer(raw[j], np.uint64)
                if min(len(p), len(q)) * den < num * max(len(p), len(q)):
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both * den >= num * (len(p) + len(q) - both):
                    root[x] = y
            top = np.fromiter(map(find, root), np.int64, len(root))
            least_of = np.full(len(nodes), np.iinfo(np.int64).max)
            np.minimum.at(least_of, top, nodes)
            least_of = least_of[top]
            joined = least_of != nodes
            if joined.any():
                yield pa.RecordBatch.from_arrays([pa.array(least_of[joined]), pa.array(nodes[joined])], ["a", "b"])

    return run


_REGION_ROW = "gid bigint, tree int, node bigint, high bigint, sig binary, crowded int"


def _regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows of all regions; rows of regions that are crowded at the least depth, or None).

    All depths of the crowded regions are counted at once: a node goes to the first depth
    at which REGION nodes or fewer agree with it.
    """
    values = F.expr(f"substring(sig, tree * {DEPTH * 2} + 1, {DEPTH * 2})")
    rows = nodes.select("node", "high", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig").select("node", "high", "tree", values.alias("run"))
    keyed = rows.withColumn("key", F.xxhash64("tree", F.expr(f"substring(run, 1, {MIN_DEPTH * 2})")))
    n = TREES * nodes.count()
    counts = materialize(sized(keyed.groupBy("key").count().where("count > 1"), n), "forest-regions")
    shared = materialize(keyed.join(counts, "key"), "forest-rows")
    full = lambda df: df.join(nodes.select("node", "high", "sig"), ["node", "high"])
    plain = shared.where(F.col("count") <= REGION).select(F.col("key").alias("gid"), "tree", "node", "high")
    crowd = shared.where(F.col("count") > REGION).select("tree", "node", "high", "run", F.col("key").alias("top"))
    if not counts.agg(F.count_if(F.col("count") > REGION)).first()[0]:
        return full(plain).withColumn("crowded", F.lit(0)), None
    at = lambda d: F.col("top") if d == MIN_DEPTH else F.xxhash64("top", F.expr(f"substring(run, 1, {d * 2})"))
    deep = crowd.select("tree", "node", "high", F.explode(F.array(*(
        F.struct(F.lit(d).alias("depth"), at(d).alias("key"), at(d - 1).alias("above")) for d in range(MIN_DEPTH + 1, DEPTH + 1)
    ))).alias("x")).select("tree", "node", "high", "x.*")
    sizes = deep.groupBy("key", "above", "depth").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    sizes = materialize(sized(sizes, n), "forest-depths")
    wide = sizes.where(F.col("n") > REGION).select(F.col("key").alias("above"))
    first = sizes.where((F.col("n") <= REGION) | (F.col("depth") == DEPTH))
    first = first.where(F.col("depth") == MIN_DEPTH + 1).unionByName(first.where(F.col("depth") > MIN_DEPTH + 1).join(wide, "above", "left_semi")).select("key", "n", "least")
    # Alike in all values of the tree: blocks of nodes, with the smallest node in each.
    blocks = F.ceil(F.col("n") / REGION)
    block = F.when((blocks > 1) & (F.col("node") == F.col("least")), F.sequence(F.lit(0).cast("bigint"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", "tree"), blocks)))
    parts = deep.join(first, "key").select("key", "tree", "node", "high", F.explode(block).alias("block")).select(F.xxhash64("key", "block").alias("gid"), "tree", "node", "high")
    marks = crowd.groupBy("node", "high").agg(F.expr("cast(bit_or(shiftleft(1, tree)) as int)").alias("crowded"))
    out = full(plain.unionByName(parts)).join(marks, ["node", "high"], "left")
    return out.withColumn("crowded", F.coalesce("crowded", F.lit(0))), crowd


def _unsettled(crowd: DataFrame, labels: DataFrame) -> DataFrame:
    """node, high, comp of the nodes of those crowded regions that hold more than one component."""
    ids = crowd.select("top", "node", "high").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = ids.groupBy("top").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("top")
    return materialize(sized(ids.join(mixed, "top").select("node", "high", "comp").distinct(), crowd.count()), "forest-unsettled")


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of the sets fall in each of COUNTERS buckets; one row per bucket met."""
    total = np.zeros(COUNTERS, np.int64)
    for b in batches:
        for raw in b.column(0).to_pylist():
            np.add.at(total, (np.frombuffer(raw, np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
    met = np.flatnonzero(total)
    for at in range(0, len(met), 10_000):
        part = met[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["bucket", "n"])


def _prefixes(common, num: int, den: int):
    """The first shingles, rarest bucket first, of each set: sets that reach the threshold share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, comp, raw in zip(*(b.column(c).to_pylist() for c in ("node", "comp", "shingles")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                n = len(s)
                first = s[np.lexsort((s, common.value[(s % np.uint64(COUNTERS)).astype(np.int64)]))][: n - -(-num * n // den) + 1]
                k = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.view(np.int64)), pa.array(np.full(k, node, np.int64)), pa.array(np.full(k, comp, np.int64)), pa.array(np.full(k, n, np.int32)), pa.array(np.arange(k, dtype=np.int32))],
                    ["shingle", "node", "comp", "n", "at"],
                )

    return run


def _candidates(num: int, den: int):
    """Pairs of a tile, of different components, that can reach the threshold by their sizes and the places of the shared shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _Groups(batches):
            node, comp, n, at, side = (g.column(c).to_numpy() for c in ("node", "comp", "n", "at", "side"))
            n, at = n.astype(np.int64), at.astype(np.int64)
            for i in np.flatnonzero(side <= 0):
                other = side > 0 if side[i] < 0 else (side > 0) | (node > node[i])
                both = np.minimum(n - at, n[i] - at[i])
                other &= (comp != comp[i]) & (np.minimum(n, n[i]) * den >= num * np.maximum(n, n[i])) & (both * den >= num * (n + n[i] - both))
                if other.any():
                    a, b = node[i], node[other]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _alike(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both * den >= num * (len(p) + len(q) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _again(docs: DataFrame, crowd: DataFrame, labels: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Second round: all links between components of crowded regions, by a prefix-filtered join of the full sets."""
    spark = docs.sparkSession
    open_ = _unsettled(crowd, labels)
    sets = docs.mapInArrow(_sets(words, Sieve(open_, "node").sent), "node bigint, high bigint, shingles binary")
    sets = materialize(open_.join(sets, ["node", "high"]).select("node", "comp", "shingles").dropDuplicates(["node"]), "forest-open")
    common = np.zeros(COUNTERS, np.int64)
    met = sets.select("shingles").mapInArrow(_bucket_counts, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    common[met.column("bucket").to_numpy()] = met.column("n").to_numpy()
    first = materialize(sets.mapInArrow(_prefixes(spark.sparkContext.broadcast(common), num, den), "shingle bigint, node bigint, comp bigint, n int, at int"), "forest-prefixes")
    sizes = first.groupBy("shingle", "comp").count()
    stats = materialize(sized(
        sizes.groupBy("shingle").agg(F.sum("count").alias("total"), F.max("count").alias("most"), F.max_by("comp", F.struct("count", -F.col("comp"))).alias("main")).where("total > most"),
        first.count(),
    ), "forest-shared")
    # A shingle's rows in tiles: strays (outside its prevailing component) with a block of the others, or with a block of strays.
    tied = first.join(stats, "shingle").withColumn("others", F.ceil(F.col("most") / REGION)).withColumn("strays", F.ceil((F.col("total") - F.col("most")) / REGION))
    own = lambda blocks: F.pmod(F.xxhash64("node"), blocks)
    tile = lambda i, j, side: F.struct(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), F.lit(side).alias("side"))
    upto = lambda blocks: F.sequence(F.lit(0).cast("bigint"), blocks - 1)
    stray = F.concat(
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.col("others") * F.col("strays") - 1),
            lambda x: F.struct((-1 - x).alias("i"), (x % F.col("strays")).alias("j"), F.lit(-1).alias("side")),
        ),
        F.transform(upto(F.col("strays")), lambda x: F.when(x == own(F.col("strays")), tile(x, x, 0)).when(x > own(F.col("strays")), tile(own(F.col("strays")), x, -1)).otherwise(tile(x, own(F.col("strays")), 1))),
    )
    stray = F.filter(stray, lambda t: (t["i"] >= 0) | (t["j"] == own(F.col("strays"))))
    main = F.transform(upto(F.col("strays")), lambda x: tile(-1 - (own(F.col("others")) * F.col("strays") + x), x, 1))
    tiles = tied.select("shingle", "node", "comp", "n", "at", F.explode(F.when(F.col("comp") == F.col("main"), main).otherwise(stray)).alias("t"))
    tiles = tiles.select(F.xxhash64("shingle", "t.i", "t.j").alias("gid"), "node", "comp", "n", "at", F.col("t.side").alias("side"))
    found = tiles.repartition("gid").sortWithinPartitions("gid").mapInArrow(_candidates(num, den), "a bigint, b bigint")
    pairs = materialize(found.distinct(), "forest-candidates")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    full = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return materialize(full.mapInArrow(_alike(num, den), "a bigint, b bigint"), "forest-links")


def _links(docs: DataFrame, regions: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b), a < b: nodes that confirmed links of one region connect."""
    s = num / den
    least = VALUES * s - SIGMAS * (VALUES * s * (1 - s)) ** 0.5
    grouped = regions.repartition("gid").sortWithinPartitions("gid", "sig")
    needed = materialize(grouped.mapInArrow(_needed(least), _REGION_ROW), "forest-needed")
    sets = docs.mapInArrow(_sets(words, Sieve(needed, "node").sent), "node bigint, high bigint, shingles binary")
    full = needed.join(sets, ["node", "high"]).select("gid", "tree", "node", "sig", "crowded", "shingles")
    found = full.repartition("gid").sortWithinPartitions("gid", "sig").mapInArrow(_confirmed(least, num, den), "a bigint, b bigint")
    return materialize(found, "forest-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): each node of ``edges`` (a, b) with the smallest node it is connected to.

    Alternates large-star and small-star steps; a step joins every node's neighbours
    with the smallest of them, found by aggregation, so a much linked node is no
    task's burden.  The number of steps grows with the logarithm of the longest path.
    """
    n = edges.count()
    edges = materialize(sized(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), n), "cc-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count("*").alias("n"))
        near = materialize(sized(near, 2 * n), "cc-near")
        if not near.agg(F.count_if((F.col("below") > 1) | (F.col("below") == 1) & (F.col("n") > 1))).first()[0]:
            break  # stars only: a node is linked with its component's smallest alone
        large = both.where("v > u").join(near.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(sized(large, 2 * n), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(sized(small.where("u <> v").distinct(), 2 * n), "cc-edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("comp"))
    )


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    Documents are linked if den * |intersection| >= num * |union| of their sets of
    ``words``-word shingles; a component's smallest id is kept.
    """
    small_batches(docs.sparkSession, 500, 4 << 20)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(texts.mapInArrow(_signed(words), "doc_id bigint, n bigint, high bigint, low bigint, sig binary"), "forest-signed")
    alike = signed.where("n > 0 and doc_id is not null").groupBy("n", "high", "low").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"))
    alike = materialize(sized(alike, signed.count()), "forest-nodes")
    regions, crowd = _regions(alike.select("node", "high", "sig"))
    links = _links(texts, regions.select("gid", "tree", "node", "high", "sig", "crowded"), words, num, den)
    labels = materialize(sized(components(links), alike.count()), "forest-components")
    if crowd is not None:
        more = _again(texts, crowd, labels, words, num, den)
        if not more.isEmpty():
            tied = labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more)
            labels = materialize(sized(components(tied), alike.count()), "forest-components")
    classes = materialize(alike.select("n", "high", "low", "node").join(labels, "node", "left").select("n", "high", "low", F.coalesce("comp", "node").alias("comp")), "forest-classes")
    tied = signed.select("doc_id", "n", "high", "low").join(classes, ["n", "high", "low"], "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("comp"))
    return tied.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` but those whose component keeps another document; all columns, whatever their names."""
    name = unused(docs, "gone")
    gone = materialize(near_duplicates(docs, words, num, den).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "forest-gone")
    maybe = Sieve(gone, name).column(F.col("doc_id"))
    tested = docs.where(maybe).join(gone.hint("shuffle_merge"), F.col("doc_id").cast("bigint") == F.col(name), "left_anti")
    return docs.where(~maybe).unionByName(tested)
