"""Mixing sources to target weights by Pfair scheduling; DataFrame code throughout.

A source with weight w = share / total gets its i-th block (from 0) released at
slot floor(i / w) with deadline ceil((i + 1) / w).  One block runs per slot: of the
released ones that with the earliest deadline, ties to the source named first.  As
the weights sum to one no deadline is missed, and at every slot each source has had
its due share of the slots so far with less than one block more or less.  The
schedule repeats after ``total`` slots (the sum of the shares, a parameter), so one
period is folded by an ``aggregate`` expression and the rest follows by arithmetic.

Inside a source documents are ordered by a hash of their id and cut into blocks of
``block_rows``.  The order is counted in hash buckets, with the sums of the buckets
before added, so no task sees a whole source.

Mixing decides the order, never the membership: every row is placed once.  The
deviation bound holds as long as no source has run out; later slots of a source that
has ended stay unused.

Defined cases: sources that ``shares`` doesn't name, null among them, are pooled as
one source under the key None (share 1 if not given); a null id sorts by the empty
string; repeated rows take a place each; an empty table gives an empty result; texts
aren't read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import materialize, unused

BUCKETS = 1024

Shares = dict[str | None, int]


def period(spark: SparkSession, shares: Shares) -> DataFrame:
    """(slot, share_no, nth): which source runs in each slot of a period, and its how manyth block it is."""
    values = list(shares.values())
    total = sum(values)
    k = F.array(*(F.lit(v).cast("bigint") for v in values))
    none = F.array(*(F.lit(0).cast("bigint") for _ in values))

    def due(had: Column, slot: Column) -> Column:
        """The released source of earliest deadline, as (deadline, number)."""
        keys = F.transform(
            F.arrays_zip(had.alias("had"), k.alias("k")),
            lambda x, i: F.when((x["had"] * total) < (slot + 1) * x["k"], F.struct((-F.floor(-((x["had"] + 1) * total) / x["k"])).alias("deadline"), i.alias("number"))),
        )
        return F.array_min(F.filter(keys, lambda x: x.isNotNull()))["number"]

    start = F.struct(none.alias("had"), F.array().cast("array<int>").alias("run"))

    def run(state: Column, slot: Column) -> Column:
        pick = due(state["had"], slot)
        return F.struct(
            F.transform(state["had"], lambda h, i: h + F.when(i == pick, 1).otherwise(0)).alias("had"),
            F.concat(state["run"], F.array(pick)).alias("run"),
        )

    folded = spark.range(1).select(F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(total - 1).cast("bigint")), start, run)["run"].alias("run"))
    slots = folded.select(F.posexplode("run").alias("slot", "share_no"))
    nth = F.row_number().over(Window.partitionBy("share_no").orderBy("slot")) - 1
    return slots.select("slot", "share_no", nth.alias("nth"))


def order_key(c: str = "doc_id") -> Column:
    """A 32-bit hash of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")


def schedule(docs: DataFrame, shares: Shares, block_rows: int) -> DataFrame:
    """doc_id, source, block, place, slot, released, deadline of every row.

    Reading by (slot, place) gives the mix: ``slot`` is the block's slot, ``place`` the
    row's number inside the block.  released and deadline are the block's window.
    """
    spark = docs.sparkSession
    shares = {**shares, None: shares.get(None, 1)}
    names, total = list(shares), sum(shares.values())
    if min(shares.values()) <= 0:
        raise ValueError("shares are positive integers")
    number = F.lit(names.index(None))
    for i, n in enumerate(names):
        if n is not None:
            number = F.when(F.col("source") == n, i).otherwise(number)
    rows = docs.select("doc_id", "source", number.alias("share_no"), order_key().alias("h"))
    rows = materialize(rows.withColumn("bucket", F.shiftright("h", 22)), "mix-rows")
    before = Window.partitionBy("share_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("share_no", "bucket").agg(F.count("*").alias("n")).select(
        "share_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )  # BUCKETS rows per source at most
    inside = Window.partitionBy("share_no", "bucket").orderBy("h", "doc_id")
    placed = rows.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["share_no", "bucket"]).withColumn("at", F.col("at") + F.col("offset"))
    share = F.element_at(F.array(*(F.lit(v).cast("bigint") for v in shares.values())), F.col("share_no") + 1)
    blocks = placed.select("doc_id", "source", "share_no", share.alias("share"), F.expr(f"at div {block_rows}").alias("block"), (F.col("at") % block_rows).cast("int").alias("place"))
    slots = F.broadcast(period(spark, shares).select("share_no", "nth", F.col("slot").alias("in_period")))  # total rows
    joined = blocks.withColumn("nth", (F.col("block") % F.col("share")).cast("int")).join(slots, ["share_no", "nth"])
    return joined.select(
        "doc_id", "source", "block", "place",
        (F.expr("block div share") * total + F.col("in_period")).alias("slot"),
        F.expr(f"(block * {total}) div share").alias("released"),
        F.expr(f"((block + 1) * {total} + share - 1) div share").alias("deadline"),
    )


def mixed(docs: DataFrame, shares: Shares, block_rows: int) -> DataFrame:
    """All rows and columns of ``docs``, whatever their names, sorted in the order of the mix."""
    name, at = unused(docs, "mix_id"), unused(docs, "mix_at")
    plan = schedule(docs, shares, block_rows).select(F.col("doc_id").alias(name), F.struct("slot", "place").alias(at))
    once = materialize(plan.groupBy(name).agg(F.min(at).alias(at)), "mix-order")
    # The order grows with the corpus: it is merged at every size, never sent to all tasks.
    return docs.join(once.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col(name)), "left").sort(at).select(*docs.columns)


def with_position(docs: DataFrame) -> DataFrame:
    """Adds position, from 0, in the order that ``mixed`` gave the rows; it replaces a column of that name.

    Reading packs files by size, so rows don't come back in order; but a sorted table's
    files are numbered in it, and each holds its rows in it.  A table that wasn't read
    from files is in its own order.
    """
    part, file, row, before = (unused(docs, n) for n in ("part_no", "file_name", "row_no", "rows_before"))
    try:
        name = F.col("_metadata.file_name")
        placed = docs.select("*", F.regexp_extract(name, r"part-(\d+)", 1).cast("int").alias(part), name.alias(file), F.col("_metadata.row_index").alias(row))
        placed.schema  # noqa: B018  (fails here where there are no files)
    except AnalysisException:
        at = F.monotonically_increasing_id()
        placed = docs.select("*", F.shiftright(at, 33).cast("int").alias(part), F.lit("").alias(file), at.bitwiseAND(F.lit((1 << 33) - 1)).alias(row))
    earlier = Window.orderBy(part, file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part, file).agg(F.count("*").alias("n")).select(part, file, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))  # a row per file
    joined = placed.join(F.broadcast(offsets), [part, file])
    return joined.select(*(c for c in docs.columns if c.lower() != "position"), (F.col(before) + F.col(row)).alias("position"))
