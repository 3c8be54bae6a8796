"""Content-addressed WARC archive.

An archive is a folder of tables in the shared folder.  ``payloads`` holds each distinct
payload once, under its SHA-256.  ``records`` holds for every capture the exact header
block of its WARC record (WARC/1.1 lines with CRLF) and the payload's address.  Reading
verifies each stored payload against its address and joins the headers with the payloads
to build the original records; what the index says of a record is taken from its bytes.

Of the captures of one payload of at least ``min_revisit_bytes`` that with the
largest page id is the response, the others are revisits that refer to it.

The holder of each digest is found by aggregating (digest, page_id) pairs; payloads
move once, at most one copy of each from every task, and are stored in buckets by address,
so that reading moves the headers to the payloads.  Captures of a payload that HEAVY or
more pages share are dealt over several tasks, which get a copy of it each.

Defined cases: null html is the empty payload; a null url gives an empty target
line; a null page_id sorts below all others (if all ids of a payload are null, all
of them are responses); repeated rows of the response's page are responses too,
and their payload is still stored once; empty tables give empty archives; extra columns
are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import fresh_path

MIN_REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed capture time: the tables carry none.
CAPTURED = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Captures of a payload that one task may take; salts of the small join that finds the holders.
HEAVY, SALTS = 1000, 8


def _header(kind: Column) -> Column:
    """The record's header block, up to and with the blank line."""
    revisit = kind == "revisit"
    length = F.when(revisit, F.lit(0).cast("bigint")).otherwise(F.col("payload_bytes"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind,
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), text("page_id"),
        F.lit(f">{CRLF}WARC-Date: {CAPTURED}{CRLF}WARC-Target-URI: "), F.regexp_replace(text("url"), "[\r\n]", ""),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{CRLF}X-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Refers-To: <urn:page:"), F.col("holder").cast("string"), F.lit(f">{CRLF}WARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length.cast("string"),
        F.lit(CRLF + CRLF),
    )


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> str:
    """Write one record per row of ``pages`` below ``path``; returns ``path``."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    captures = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    captures.select(
        "page_id", "url", "address", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes")
    ).write.parquet(f"{path}/captures")
    facts = spark.read.parquet(f"{path}/captures").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    facts.groupBy("address").agg(F.max("page_id").alias("holder"), F.count("*").alias("captures")).write.parquet(f"{path}/holders")
    holders = spark.read.parquet(f"{path}/holders").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & F.coalesce(F.col("page_id") != F.col("holder"), F.col("holder").isNotNull())
    facts.join(holders, ["address", "salt"]).select(
        "page_id", "address", "captures", F.encode(_header(F.when(revisit, "revisit").otherwise("response")), "UTF-8").alias("header")
    ).write.parquet(f"{path}/records")
    # Every task keeps one copy of a payload before the shuffle, so a much repeated one stays small.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"warc_{uuid.uuid4().hex}"
    once = captures.groupBy("address").agg(F.first("payload").alias("payload"), F.count("*").alias("captures"))
    once.write.format("parquet").bucketBy(buckets, "address").option("path", f"{path}/payloads").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay: the archive is known by its path
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/layout")
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(address, captures, payload), in buckets by address, with every payload verified against its address."""
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    table = f"warc_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} (address STRING, payload BINARY, captures BIGINT) USING parquet CLUSTERED BY (address) INTO {buckets} BUCKETS LOCATION '{path}/payloads'")
    stored = spark.table(table)
    stored.schema  # noqa: B018  (resolved here, the name isn't needed any more)
    spark.sql(f"DROP TABLE {table}")
    return stored.select("address", "captures", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address")))).alias("payload"))


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)", 1)


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, header, record, payload): the exact record bytes, and the full payload of revisits too."""
    records = spark.read.parquet(f"{path}/records")
    payloads = read_payloads(spark, path)
    salts = F.ceil(F.col("captures") / HEAVY)
    dealt = records.where(F.col("captures") > HEAVY).withColumn("salt", F.pmod(F.xxhash64("page_id", "header"), salts)).drop("captures")
    copies = payloads.where(F.col("captures") > HEAVY).select("address", "payload", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    columns = ["page_id", "header", "payload"]
    light = records.where(F.col("captures") <= HEAVY).join(payloads.where(F.col("captures") <= HEAVY).drop("captures"), "address").select(columns)
    both = light.unionByName(dealt.join(copies, ["address", "salt"]).select(columns))
    body = F.when(_field("WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return both.select("page_id", "header", F.concat(F.col("header"), body, F.encode(F.lit(CRLF + CRLF), "UTF-8")).alias("record"), "payload")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from its rebuilt bytes."""
    built = reconstruct(spark, path)
    body = F.expr(f"substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - {2 * len(CRLF)})")
    built = built.select(F.expr("substring(record, 1, octet_length(header))").alias("header"), body.alias("body"), "payload")
    kind = _field("WARC-Type")
    said = built.select(
        _field("WARC-Record-ID").alias("record_id"), kind.alias("record_type"), _field("WARC-Refers-To").alias("refers"), _field("WARC-Payload-Digest").alias("digest"),
        _field("Content-Length").cast("bigint").alias("length"), F.octet_length("body").cast("bigint").alias("body_bytes"),
        F.when(kind == "revisit", F.col("payload")).otherwise(F.col("body")).alias("full"),
    ).withColumn("sha1", F.sha1("full"))
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(.*)>', 1), '') as bigint)")
    right = (F.col("digest") == F.concat(F.lit("sha1:"), F.col("sha1"))) & (F.col("length") == F.col("body_bytes"))
    return said.select(
        number("record_id").alias("page_id"), F.octet_length("full").cast("bigint").alias("payload_bytes"),
        F.when(right, F.col("sha1")).otherwise(F.raise_error(F.lit("header and record differ"))).alias("payload_digest"), "record_type", number("refers").alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new archive and read it back."""
    spark = pages.sparkSession
    return read_index(spark, write_archive(pages, fresh_path(spark, "warc")))
