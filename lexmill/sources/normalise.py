"""Shapes of incoming rows: each shape is one select, and shapes meet in a union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

NLI_LABELS = ["contradiction", "entailment", "neutral"]


def nli_label(text: Column) -> Column:
    """Label of free text; neutral by default."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(low.contains("entail") | low.isin("yes", "true"), "entailment").when(low.contains("contrad") | low.isin("no", "false"), "contradiction").otherwise("neutral")


def nli_code(code: Column, order: list[str] | None = None) -> Column:
    """Label of an integer code.  The two corpora number labels differently: contracts by
    NLI_LABELS, the general one by entailment, neutral, contradiction."""
    names = order or NLI_LABELS
    out = F.lit("neutral")
    for i, n in enumerate(names):
        out = F.when(code == i, n).otherwise(out)
    return out


def contract_pairs(rows: DataFrame) -> DataFrame:
    """source_id, premise, hypothesis, label from three shapes.

    Columns: id, input, output (a question and its context in one text), premise,
    hypothesis, label (one pair), hypotheses, labels (several for one premise); those of
    other shapes are null.
    """
    at = F.regexp_extract("input", r"(?s)^(.*?)\n*Context:(.*)$", 1), F.regexp_extract("input", r"(?s)^(.*?)\n*Context:(.*)$", 2)
    split = F.col("input").contains("Context:")
    one = rows.where(F.col("input").isNotNull() & F.col("premise").isNull()).select(
        F.col("id").alias("source_id"), F.trim(F.when(split, at[1]).otherwise(F.col("input"))).alias("premise"),
        F.trim(F.when(split, F.replace(at[0], F.lit("Q:"), F.lit(""))).otherwise(F.substring("input", 1, 300))).alias("hypothesis"), nli_label(F.col("output")).alias("label"),
    )
    code = F.expr("try_cast(label AS int)")
    named = F.when(code.isNotNull(), nli_code(code)).otherwise(nli_label(F.col("label")))
    two = rows.where(F.col("premise").isNotNull() & F.col("hypothesis").isNotNull()).select(F.col("id").alias("source_id"), F.trim("premise").alias("premise"), F.trim("hypothesis").alias("hypothesis"), named.alias("label"))
    many = rows.where(F.col("premise").isNotNull() & F.col("hypothesis").isNull() & F.col("hypotheses").isNotNull()).select(
        "id", "premise", F.posexplode(F.arrays_zip("hypotheses", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))).alias("i", "x")
    )
    three = many.select(F.concat_ws("::", "id", "i").alias("source_id"), F.trim("premise").alias("premise"), F.trim("x.hypotheses").alias("hypothesis"), nli_label(F.col("x.labels")).alias("label"))
    return one.unionByName(two).unionByName(three).where("premise <> '' and hypothesis <> ''")


def valid_unique_pairs(pairs: DataFrame, order: list[str]) -> DataFrame:
    """Pairs with a known label, the first of each (premise, hypothesis)."""
    known = pairs.where(F.col("label").isin(NLI_LABELS) & (F.trim("premise") != "") & (F.trim("hypothesis") != ""))
    cols = [c for c in known.columns if c not in ("premise", "hypothesis")]
    first = known.groupBy("premise", "hypothesis").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("x"))
    return first.select("premise", "hypothesis", "x.*")


def qa_examples(rows: DataFrame) -> DataFrame:
    """example_id, question, answer, chunk_id, text, doc_name, page: one row per piece of evidence.

    Columns: id, question, answer, doc_name, and the evidence as one of evidence_text
    (string), evidence_lists (struct of arrays, zipped to the longest), evidence_items
    (array of struct).  Rows without question, answer or evidence are left out.
    """
    item = "array<struct<text:string,doc_name:string,page:string>>"
    lists = F.arrays_zip(F.col("evidence_lists.text").alias("text"), F.col("evidence_lists.doc_name").alias("doc_name"), F.col("evidence_lists.page").alias("page")).cast(item)
    single = F.array(F.struct(F.col("evidence_text").alias("text"), F.lit(None).cast("string").alias("doc_name"), F.lit(None).cast("string").alias("page"))).cast(item)
    some = F.coalesce(F.when(F.col("evidence_text").isNotNull(), single), F.when(F.col("evidence_lists").isNotNull(), lists), F.col("evidence_items").cast(item))
    flat = rows.where("trim(coalesce(question, '')) <> '' and trim(coalesce(answer, '')) <> ''").select(F.col("id").alias("example_id"), F.trim("question").alias("question"), F.trim("answer").alias("answer"), F.col("doc_name").alias("own"), F.posexplode(some).alias("i", "e"))
    return flat.where("trim(coalesce(e.text, '')) <> ''").select(
        "example_id", "question", "answer", F.concat(F.lit("FB-"), X.sha_prefix(F.concat_ws("\0", "example_id", F.col("i").cast("string"), F.trim("e.text")), 16)).alias("chunk_id"),
        F.trim("e.text").alias("text"), F.coalesce("e.doc_name", "own").alias("doc_name"), F.expr("try_cast(e.page AS int)").alias("page"),
    )


def partitioned(rows: DataFrame, split: str, *keys: str, limit: int | None = None) -> DataFrame:
    """Rows of a split derived from a source without splits: a document stays in one split for good."""
    key = F.coalesce(*(F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys), F.substring(F.to_json(F.struct(*sorted(rows.columns))), 1, 500))
    out = rows.where(X.hash_split(key) == split)
    return out.limit(limit) if limit is not None else out


def sample_rows(rows: DataFrame, seed: int, key: str, limit: int | None = None) -> DataFrame:
    """A seeded shuffle, cut to ``limit``; a seed of 0 is a seed like any other."""
    ordered = rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return ordered.limit(limit) if limit is not None else ordered


def typed_records(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """String columns to their types: '', 'None' and 'null' are null, booleans take 1, true and yes; other columns go."""

    def one(f: T.StructField) -> Column:
        v = F.when(~F.trim(F.col(f.name)).isin("", "None", "null"), F.trim(F.col(f.name))) if f.name in raw.columns else F.lit(None).cast("string")
        if isinstance(f.dataType, T.BooleanType):
            return F.when(v.isNotNull(), F.lower(v).isin("1", "true", "yes")).alias(f.name)
        return v.try_cast(f.dataType).alias(f.name)

    return raw.select(*map(one, schema.fields))


def yes_no(*cs: str) -> Column:
    """1 or 0 of the first column with a recognised answer."""
    one = lambda c: F.when(F.lower(F.trim(c)).isin("1", "yes", "y", "true"), 1).when(F.lower(F.trim(c)).isin("0", "no", "n", "false"), 0)
    return F.coalesce(*map(one, cs))


def masked(settings: Column) -> Column:
    """A map with the values of secret-looking keys masked."""
    return F.transform_values(settings, lambda k, v: F.when(F.lower(k).rlike("key|token|secret|password"), F.lit("***")).otherwise(v))
