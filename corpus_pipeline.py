"""Corpus pipeline: quality rules, near-duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.bpe import encode_decode
from lexmill.llm.mixing import mixed, with_position
from lexmill.llm.neardup import drop_near_duplicates
from lexmill.llm.quality import quality_filter
from lexmill.llm.queries import BLOCK_ROWS, BYTE_BPE, SHARES
from lexmill.llm.workspace import fresh_path, read_table
from lexmill.session import drop_scratch, scratch_mark


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's adaptive thresholds."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets agree to 0.8 or more."""
    return drop_near_duplicates(docs, words=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted into the Pfair order of their sources' target shares."""
    return mixed(docs, SHARES, BLOCK_ROWS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Position in the mix, token counts, and digests of ids and decoded bytes."""
    return encode_decode(with_position(docs), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, carried=("position",))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]

#: Hash-based signatures and token digests aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage.  Once a stage's table is written, what led to it is deleted."""
    docs = read_table(spark, sf_dir, "documents")
    mark = scratch_mark()
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_scratch(spark, mark, keep=(path,))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
