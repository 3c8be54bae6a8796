"""Lines, clauses, token chunks and margin blocks of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def lines(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, line: the non-blank lines, trimmed."""
    split = docs.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
    return split.withColumn("line", F.trim("line", F.lit(" \t\n\x0b\f\r"))).where("line <> ''")


def token_chunks(docs: DataFrame, keys: list[str], text: str, size: int = 512, overlap: int = 64, least: int = 40) -> DataFrame:
    """keys, chunk_no, token_start, token_end, chunk: sliding windows over white-space tokens.

    Windows step by size - overlap and end with the first that reaches the text's end;
    those under ``least`` tokens are dropped, but counted.
    """
    step = size - overlap
    w = docs.select(*keys, X.ws_tokens(text).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - size) / step), F.lit(0)).cast("bigint")
    spread = w.select(*keys, "w", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_no"))
    start = F.col("chunk_no") * step
    end = F.least(start + size, F.size("w").cast("bigint"))
    return spread.select(
        *keys, "chunk_no", start.alias("token_start"), end.alias("token_end"), F.array_join(F.slice("w", (start + 1).cast("int"), F.lit(size)), " ").alias("chunk")
    ).where(F.col("token_end") - F.col("token_start") >= least)


def carry_heading(ordered: DataFrame, keys: list[str], order: list[str], is_heading, heading) -> DataFrame:
    """Adds section: the latest heading at or before the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ordered.withColumn("section", F.last(F.when(is_heading, heading), ignorenulls=True).over(w))


def candidates(docs: DataFrame, keys: list[str], text: str, spaced: bool = False) -> DataFrame:
    """keys, grp, section, clause: non-empty runs of lines between headings and numbered lines.

    A heading ends a candidate and gives the section; a numbered line begins one; other
    lines join the one before.  With ``spaced`` one blank stands between a number and its text.
    """
    marked = lines(docs, keys, text).withColumn("head", F.when(X.maybe_heading(F.col("line")), X.is_heading(X.normalise("line") if spaced else F.col("line"))).otherwise(False))
    sectioned = carry_heading(marked, keys, ["pos"], F.col("head"), X.normalise("line"))
    w = Window.partitionBy(*keys).orderBy("pos")
    numbered = X.is_numbered(F.col("line"))
    starts = numbered | F.coalesce(F.lag("head").over(w), F.lit(True))
    body = sectioned.withColumn("starts", starts.cast("int")).where("not head")
    if spaced:
        body = body.withColumn("line", F.when(numbered, F.trim(F.concat_ws(" ", F.regexp_extract("line", X.NUMBERED, 1), F.trim(F.regexp_extract("line", X.NUMBERED, 2))))).otherwise(F.col("line")))
    grouped = body.withColumn("grp", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = grouped.groupBy(*keys, "grp").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("raw"), F.max_by("section", "pos").alias("section")
    )
    return joined.where(~X.is_blank("raw")).select(*keys, "grp", "section", X.normalise("raw").alias("clause"))


def numbered_clauses(kept: DataFrame, keys: list[str]) -> DataFrame:
    no = F.row_number().over(Window.partitionBy(*keys).orderBy("grp"))
    return kept.withColumn("clause_no", no.cast("bigint")).select(*keys, "clause_no", F.format_string("C%04d", "clause_no").alias("clause_id"), "section", "clause")


def clauses(docs: DataFrame, keys: list[str], text: str, min_words: int = 1) -> DataFrame:
    """keys, clause_no, clause_id, section, clause: the candidates of ``min_words`` and more; ``fold_clauses`` merges short ones instead."""
    return numbered_clauses(candidates(docs, keys, text).where(X.word_count("clause") >= min_words), keys)


# Fixed value: what a candidate is that holds nothing but its number.
MARKER = r"(?i)^(?:\d+(?:\.\d+)*|[A-Z]|[IVXLC]+)[.)]$"


def fold_clauses(docs: DataFrame, keys: list[str], text: str, min_words: int = 3) -> DataFrame:
    """keys, clause_no, clause_id, section, clause: the candidates, short ones merged into neighbours.

    A candidate is short if it is a bare number or has under ``min_words`` words.  A full one
    takes a short one that stands right before it as its beginning, and its section where it
    has none; of several short ones in a row only the last is taken.  A short one at the end of
    the document is added to the last full one.
    """
    w = Window.partitionBy(*keys).orderBy("grp")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    short = F.col("clause").rlike(MARKER) | ~X.has_words("clause", min_words)
    seen = candidates(docs, keys, text, spaced=True).withColumn("short", short)
    before = F.when(F.lag("short").over(w), F.struct(F.lag("clause").over(w).alias("clause"), F.lag("section").over(w).alias("section")))
    end = F.when(F.last("short").over(all_), F.last("clause").over(all_))
    seen = seen.withColumns({"before": before, "end": end, "last_full": F.max(F.when(~F.col("short"), F.col("grp"))).over(all_)})
    tail = F.when(F.col("grp") == F.col("last_full"), F.col("end"))
    kept = seen.where(~F.col("short")).withColumn("section", F.coalesce("section", "before.section")).withColumn("clause", F.concat_ws(" ", "before.clause", "clause", tail))
    return numbered_clauses(kept, keys)


def drop_margin_blocks(blocks: DataFrame, doc: str, page: str, text: str, in_margin, longest: int = 160, share: float = 0.5) -> DataFrame:
    """Rows whose text doesn't repeat in the margins of at least ``share`` of the document's pages (two at least)."""
    pages = blocks.groupBy(doc).agg(F.count_distinct(page).alias("pages"))
    seen = blocks.where(in_margin & (F.length(text) <= longest) & (F.col(text) != "")).groupBy(doc, text).agg(F.count_distinct(page).alias("seen"))
    repeated = seen.join(pages, doc).where((F.col("pages") >= 2) & (F.col("seen") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * share)))).select(doc, text)
    return blocks.join(repeated, [doc, text], "left_anti")
