"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .codes import code_vectors
from .html_text import extract_main_text
from .langid import predicted_languages
from .licenses import scan_licenses
from .merkle import tamper_check
from .mixing import schedule
from .neardup import near_duplicates
from .quality import quality_verdicts
from .repair import token_round_trip
from .sharding import shard_documents
from .topk import top_k
from .warc import archive_round_trip
from .workspace import read_table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"

#: Target shares of the sources, of 1000; the last pools all others.
SHARES: dict[str | None, int] = {"src0": 240, **{f"src{i}": 38 for i in range(1, 20)}, None: 38}
BLOCK_ROWS = 16


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(read_table(spark, sf_dir, "documents"), SHARES, BLOCK_ROWS)


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, 64.0)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read_table(spark, sf_dir, "pages"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op9_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), 40)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tamper_check(read_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted_languages(read_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_token_shards, op3_exact_top_k, op4_license_scan, op5_quality_rules,
        op6_byte_bpe, op7_warc_archive, op8_main_text, op9_shard_documents, op10_near_duplicates,
        op11_merkle_manifest, op12_language_id, op13_vector_codes,
    )
}
