"""Merkle manifest of a dataset: bottom-up build, top-down proof push.

Every row is a leaf; a tree per group (a language) stands over its leaves in order, and one
more tree over the groups' subroots.  Up: ``FANOUT`` consecutive nodes become the digest of
their digests, level by level, and each level is written as a table.  Down: a level's rows
join their parents, which know the digests of their run; each child puts its siblings before
the proof that its parent has inherited.  A leaf's proof is then the siblings on its way up,
and anyone who has a row, its proof and the root can check the row alone (``folded``).

A level has an eighth of the rows of the one below, so all levels together cost a seventh
more than the leaves, and the number of rounds grows with the logarithm of the largest
group.  Texts are read once, to hash them; only digests move.  Places come from sorted ranges
and the counts of the ranges before, so that a group of any size is spread over all tasks.

Digest: lower-case hex of SHA-256; several digests are hashed as one hex text.  A field is
``-`` if null, else the count of its UTF-8 bytes, ``:`` and the value.

Defined cases: null and empty fields differ by their encoding; a null group is a tree of its
own and comes first; null order values come first, ties are ordered by the leaf, so that equal
rows take neighbouring places with different proofs; a group of one row has its leaf as its
subroot; a single group's subroot is the root; without any sibling the proof is empty; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialize

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(c: Column) -> Column:
    """A value as it enters a leaf."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, a row's place in its ``tree`` in ``order``, and n, the rows of that tree."""
    at = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    lined = materialize(ranges.withColumns({"span": F.shiftright(at, 33), "place": at.bitwiseAND(F.lit((1 << 33) - 1))}), "manifest-places")
    runs = lined.groupBy("tree", "span").agg(F.count("*").alias("m"), F.min("place").alias("first"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    # A row per tree and range that it lies in.
    shifts = materialize(runs.select("tree", "span", (F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("m").over(whole).alias("n")), "manifest-shifts")
    return lined.join(shifts, ["tree", "span"]).withColumn("idx", F.col("place") + F.col("shift")).drop("span", "place", "shift")


def parents(level: DataFrame) -> DataFrame:
    """The level above: each run of ``FANOUT`` nodes as one, with the digests of the run.

    The root of a tree that is complete already goes up as it is, so that all trees end on the same level.
    """
    run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda k: k["digest"])
    up = level.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("idx"), F.col("n").alias("below")).agg(run.alias("kids"))
    digest = F.when(F.col("below") > 1, F.sha2(F.concat_ws("", "kids"), 256)).otherwise(F.get("kids", F.lit(0)))
    return up.select("tree", "idx", F.expr(f"(below + {FANOUT - 1}) div {FANOUT}").alias("n"), digest.alias("digest"), "kids")


def grow(leaves: DataFrame, order: list[str]) -> list[DataFrame]:
    """Levels of nodes (tree, idx, n: nodes of the tree on this level, digest, kids) over ``leaves`` (tree, digest,
    and what else a leaf carries), from the leaves to the level where each tree has one node; each is a written table."""
    levels = [materialize(placed(leaves, order), "manifest-0")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(materialize(parents(levels[-1]), f"manifest-{len(levels)}"))
        most = -(-most // FANOUT)
    return levels


def push_proofs(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with proof: array of (at: place in the run, siblings), leaf's level first.

    ``tops`` has a row per tree: the proof that its root inherits, and columns that each leaf takes over.
    """
    taken = [c for c in tops.columns if c not in ("tree", "proof")]
    below = levels[-1].join(tops, "tree")
    for level in reversed(levels[:-1]):
        up = below.select("tree", F.col("idx").alias("parent"), F.col("kids").alias("run"), F.col("proof").alias("suffix"), *taken)
        at = (F.col("idx") % FANOUT).cast("int")
        siblings = F.concat(F.slice("run", F.lit(1), at), F.slice("run", at + 2, F.lit(FANOUT)))
        own = F.array(F.struct(at.alias("at"), siblings.alias("siblings")))
        proof = F.when(F.col("n") > 1, F.concat(own, "suffix")).otherwise(F.col("suffix"))
        below = level.withColumn("parent", F.expr(f"idx div {FANOUT}")).join(up, ["tree", "parent"]).withColumn("proof", proof).drop("parent", "run", "suffix")
    return below


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and its ``proof`` lead to."""

    def up(digest: Column, step: Column) -> Column:
        left, right = F.slice(step["siblings"], F.lit(1), step["at"]), F.slice(step["siblings"], step["at"] + 1, F.lit(FANOUT))
        return F.sha2(F.concat(F.concat_ws("", left), digest, F.concat_ws("", right)), 256)

    return F.aggregate(proof, leaf, up)


def manifest(rows: DataFrame, group: str, order: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Of each row of ``rows`` (with its ``digest``): order, digest, carried columns, subroot, root, proof."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = materialize(rows.select(key.alias("tree"), order, "digest", *carried), "manifest-leaves")
    levels = grow(leaves, [order, "digest", *carried])
    crown = grow(levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest"), ["member"])
    nothing = F.array().cast("array<struct<at:int,siblings:array<string>>>")
    top = crown[-1].select("tree", F.col("digest").alias("root"), nothing.alias("proof"))
    tops = materialize(push_proofs(crown, top).select(F.col("member").alias("tree"), F.col("digest").alias("subroot"), "root", "proof"), "manifest-tops")
    return push_proofs(levels, tops).select(order, "digest", *carried, "subroot", "root", "proof")


def tamper_check(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The rows in question (3 divides the CRC-32 of the decimal id) are tampered with: A-Z of the text in lower case.
    A row without such letters stays as it is and is verified like the others.
    """
    c = {f: F.col(f) for f in FIELDS}
    chosen = F.coalesce(F.crc32(F.encode(c["doc_id"].cast("string"), "UTF-8")) % 3 == 0, F.lit(False))
    changed = leaf_digest([F.translate(x, _UPPER, _LOWER) if f == "text" else x for f, x in c.items()])
    rows = docs.select("doc_id", "lang", leaf_digest(list(c.values())).alias("digest"), F.when(chosen, changed).alias("tampered"))
    proved = manifest(rows, "lang", "doc_id", ("tampered",))
    proof = F.flatten(F.transform("proof", lambda p: p["siblings"]))
    found = proved.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.concat_ws("", proof), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("proof")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
