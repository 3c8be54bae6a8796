"""Lists of inputs: contract clauses, the parser's gold, candidates for the benchmark, document manifests."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _or_null(rows: DataFrame, *names: str) -> list[Column]:
    return [F.col(n).cast("string") if n in rows.columns else F.lit(None).cast("string") for n in names]


def _filled(*cs: Column) -> Column:
    """The first value that isn't blank, trimmed; else null."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs))


def contract_clauses(rows: DataFrame, dataset: str, split: str, least: int = 5, limit: int | None = None) -> DataFrame:
    """source_id, document_id, text, question, dataset, split of clauses in either of two shapes.

    A row with a clause (or text) is one clause; else each of answers.text is one, numbered
    by its place.  Clauses under ``least`` words go.  A direct row that has neither file
    name nor id is named by its text's hash.  ``limit`` counts clauses, not rows.
    """
    clause, text, file_name, title, key, label, question = _or_null(rows, "clause", "text", "file_name", "title", "id", "label", "question")
    answers = F.col("answers.text") if "answers" in rows.columns else F.lit(None).cast("array<string>")
    one = _filled(clause, text)
    shaped = rows.select(
        one.alias("one"), _filled(file_name).alias("file"), _filled(title).alias("title"), _filled(key).alias("key"), label.alias("label"), question.alias("question"),
        F.when(one.isNotNull(), F.array(one)).otherwise(answers).alias("texts"),
    )
    long = shaped.select("*", F.posexplode("texts").alias("at", "t"))
    direct = F.col("one").isNotNull()
    named = F.coalesce("file", "key", F.concat(F.lit("clause-"), X.sha_prefix("one", 16)))
    placed = F.concat(F.coalesce("key", F.lit(dataset)), F.lit("::"), F.col("at"))
    out = long.select(
        F.when(direct, named).otherwise(placed).alias("source_id"),
        F.when(direct, F.coalesce("file", "key", F.lit("unknown"))).otherwise(F.coalesce("file", "title", "key", F.lit("unknown"))).alias("document_id"),
        F.trim("t").alias("text"), F.coalesce(F.when(direct, F.col("label")).otherwise(F.col("question")), F.lit("")).alias("question"),
        F.lit(dataset).alias("dataset"), F.lit(split).alias("split"),
    ).where(X.word_count("text") >= least)
    return out if limit is None else out.limit(limit)


def gold_clauses(rows: DataFrame, path: str, clause: str, at: str) -> DataFrame:
    """path, gold_clauses: a document's clauses in the order of ``at``; rows without path or clause go."""
    kept = rows.select(_filled(F.col(path)).alias("path"), _filled(F.col(clause)).alias("clause"), F.col(at).alias("at")).where("path is not null and clause is not null")
    listed = F.array_sort(F.collect_list(F.struct("at", "clause")))  # one document's clauses
    return kept.groupBy("path").agg(F.transform(listed, lambda x: x["clause"]).alias("gold_clauses"))


def parser_gold(spark: SparkSession, manifest: str) -> DataFrame:
    """path, gold_clauses from a JSON list of such rows, or a CSV of path, gold_clause.

    A JSON row that lacks either fails the query.  CSV rows keep the file's order.
    """
    if manifest.lower().endswith(".json"):
        rows = spark.read.schema("path string, gold_clauses array<string>").json(manifest, multiLine=True)
        bad = F.coalesce(F.trim("path"), F.lit("")) == ""
        return rows.where(F.when(bad | F.col("gold_clauses").isNull(), F.raise_error(F.lit("every row requires path and gold_clauses")).isNull()).otherwise(True))
    rows = spark.read.csv(manifest, header=True, multiLine=True, escape='"').withColumn("__at", F.monotonically_increasing_id())
    return gold_clauses(rows, "path", "gold_clause", "__at")


def candidates(tiers: list[tuple[str, DataFrame, bool]], labels: list[str], at: str, least: int = 8) -> DataFrame:
    """source_id, document_id, risk_label, text, tier of rows that may enter the benchmark.

    Tiers are (name, rows, reviewed only), best first.  A row stays if its label is one of
    ``labels`` by its key, its normalised text has ``least`` words, it is kept out of
    training, and it was reviewed where the tier asks for that.  Of rows that share a source
    id the first of the best tier stays, by ``at``.
    """
    by_key = F.map_from_arrays(F.array(*(X.label_key(F.lit(x)) for x in labels)), F.array(*map(F.lit, labels)))
    parts = []
    for n, (name, rows, reviewed) in enumerate(tiers):
        ok = F.coalesce(F.col("excluded_from_training"), F.lit(False)) & (F.coalesce(F.col("human_reviewed"), F.lit(False)) if reviewed else F.lit(True))
        parts.append(rows.where(ok).select(
            _filled(F.col("source_id").cast("string")).alias("source_id"), _filled(F.col("document_id").cast("string")).alias("document_id"),
            F.try_element_at(by_key, X.label_key("risk_label")).alias("risk_label"), X.normalise("text").alias("text"), F.lit(name).alias("tier"), F.lit(n).alias("__tier"), F.col(at).alias("__at"),
        ))
    every = reduce(DataFrame.unionByName, parts).where("source_id is not null and risk_label is not null").where(X.word_count("text") >= least)
    first = every.groupBy("source_id").agg(F.min_by(F.struct("document_id", "risk_label", "text", "tier"), F.struct("__tier", "__at")).alias("x"))
    return first.select("source_id", F.coalesce("x.document_id", "source_id").alias("document_id"), "x.risk_label", "x.text", "x.tier")


def document_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """path, metadata (map of the other columns) from a CSV or JSON list.  Relative paths stand beside the manifest."""
    if manifest.lower().endswith(".json"):
        rows = spark.read.json(manifest, multiLine=True, primitivesAsString=True)
    else:
        rows = spark.read.csv(manifest, header=True, multiLine=True, escape='"')
    home = str(PurePosixPath(urlparse(manifest).path).parent)
    prefix = manifest[: manifest.index(home)] + home if home != "." else ""
    path = F.when(F.col("path").rlike("^(/|[a-z0-9]+:/)"), F.col("path")).otherwise(F.concat(F.lit(prefix + "/" if prefix else ""), "path"))
    others = [x for c in rows.columns if c != "path" for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return rows.select(path.alias("path"), (F.create_map(*others) if others else F.lit(None).cast("map<string,string>")).alias("metadata"))


DIMENSIONS = ["document_type", "jurisdiction", "scan_quality", "length_band"]


def by_dimension(documents: DataFrame, metrics: list[str], dimensions: list[str] | None = None) -> DataFrame:
    """dimension, value, documents, mean_<metric>: means of the documents whose status is ok, per value of each dimension.

    ``documents`` has status, metadata and the metrics.  A dimension that is missing or blank
    is "unspecified".  documents counts those of the metric that most documents have.
    """
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.nullif(F.try_element_at("metadata", F.lit(d)), F.lit("")), F.lit("unspecified")).alias("value")) for d in dimensions or DIMENSIONS))
    long = documents.where("status = 'ok'").select(*metrics, F.explode(pairs).alias("x"))
    counts = [F.count(m) for m in metrics]
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    return long.groupBy("x.dimension", "x.value").agg(most.alias("documents"), *(F.avg(m).alias(f"mean_{m}") for m in metrics))
