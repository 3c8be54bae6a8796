"""The regulatory corpus: documents named by pins, as a table and as a stream.

A pin is (source, url, path).  ``PinnedDocuments`` is a Python data source: a partition per
pin, so that fetching is spread over the cluster, and predicates on source and url are pushed
into it, so that documents that they rule out are never opened.  Paths are opened through the
file system of their URI (s3, gs, hdfs, file; a bare path is local); a document that can't be read is an error
of its row, and other pins go on.

As a stream the source follows an append-only log of pins: JSON-lines files of a folder, later
ones with greater names.  An offset is a place in the log (file, line).  At most
``maxDocuments`` pins are let in a batch; where the last batch ended is read from the query's
own offset log (option ``checkpoint``), so that a restart goes on there and reads no document twice.
A batch costs the driver some half a second whatever it holds, so a long log is read by several
streams: with option ``shard`` k of ``shards`` n a stream takes every n-th line of each file.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cached_property, reduce
from itertools import islice, takewhile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..functions import text as X
from ..operators import segment
from ..session import file_status, ship
from . import files

DOCUMENT = "source string, url string, content string, error string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def fetch(pin: dict) -> tuple:
    """A row of DOCUMENT."""
    try:
        system, path = opened(pin["path"])
        with system.open_input_stream(path) as f:
            return pin.get("source"), pin.get("url"), f.read().decode("utf-8", "replace"), None
    except (OSError, pa.ArrowException) as e:
        return pin.get("source"), pin.get("url"), None, str(e)


def holds(pin: dict, f: Filter) -> bool | None:
    """Whether a pushed filter holds for a pin; None if it isn't on the source or url alone."""
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column not in ("source", "url"):
        return None
    value = pin.get(column)
    if isinstance(f, EqualTo):
        return value is not None and value == f.value
    if isinstance(f, In):
        return value is not None and value in f.value
    if isinstance(f, StringStartsWith):
        return value is not None and value.startswith(f.value)
    return None


class Pins(InputPartition):
    def __init__(self, pins: list[dict]) -> None:
        self.pins = pins


class PinnedDocuments(DataSource):
    """A table of option ``pins`` (JSON list of objects with source, url and path), or a stream of the
    pin log in option ``path``, with ``maxDocuments`` a batch, ``perTask`` a task, and ``checkpoint``."""

    @classmethod
    def name(cls) -> str:
        return "pinned_documents"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["pins"]))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogReader(self.options["path"], self.options.get("checkpoint"), int(self.options.get("maxDocuments", 10_000)), int(self.options.get("perTask", 64)), int(self.options.get("shard", 0)), int(self.options.get("shards", 1)))


class _Reader(DataSourceReader):
    def __init__(self, pins: list[dict]) -> None:
        self.pins = pins

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if self.pins and holds(self.pins[0], f) is None:
                yield f
            else:
                self.pins = [p for p in self.pins if holds(p, f)]

    def partitions(self) -> list[InputPartition]:
        return [Pins([p]) for p in self.pins] or [Pins([])]

    def read(self, partition: Pins) -> Iterator[tuple]:
        yield from map(fetch, partition.pins)


START = {"file": "", "line": 0}


class PinLog:
    """Pins in the order of the log: the files' names, then their lines; of these every ``shards``-th, from ``shard`` on."""

    def __init__(self, path: str, shard: int = 0, shards: int = 1) -> None:
        self.system, self.path = opened(path)
        self.shard, self.shards = shard, shards
        self.held: tuple[tuple, list[str]] = ((), [])  # the file read last, as batches go on in it

    def after(self, offset: dict) -> Iterator[tuple[dict, dict]]:
        """(the offset behind a pin, the pin), from ``offset`` on; files before it aren't opened."""
        listed = self.system.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        logged = {f.base_name: f for f in listed if f.is_file and not f.base_name.startswith(("_", "."))}
        for name in sorted(n for n in logged if n >= offset["file"]):
            skip = offset["line"] if name == offset["file"] else 0
            lines = self._lines(name, (name, logged[name].size, logged[name].mtime_ns))
            for i in range(skip + (self.shard - skip) % self.shards, len(lines), self.shards):
                if lines[i].strip():
                    yield {"file": name, "line": i + 1}, json.loads(lines[i])

    def _lines(self, name: str, state: tuple) -> list[str]:
        if self.held[0] != state:
            with self.system.open_input_stream(f"{self.path}/{name}") as f:
                self.held = state, f.read().decode().splitlines()
        return self.held[1]


def last_logged(checkpoint: str | None) -> dict:
    """The end of the last batch that the query's offset log names."""
    if not checkpoint:
        return START
    system, path = opened(checkpoint)
    listed = system.get_file_info(fs.FileSelector(f"{path}/offsets", allow_not_found=True))
    batches = sorted(int(f.base_name) for f in listed if f.base_name.isdigit())
    if not batches:
        return START
    with system.open_input_stream(f"{path}/offsets/{batches[-1]}") as f:
        return json.loads(f.read().decode().splitlines()[-1])


class _LogReader(DataSourceStreamReader):
    def __init__(self, path: str, checkpoint: str | None, most: int, per_task: int, shard: int = 0, shards: int = 1) -> None:
        self.path, self.checkpoint, self.most, self.per_task, self.shard, self.shards = path, checkpoint, most, per_task, shard, shards

    @cached_property
    def log(self) -> PinLog:
        """Made where offsets are asked for, so that tasks don't get what it holds."""
        return PinLog(self.path, self.shard, self.shards)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "log"}

    def initialOffset(self) -> dict:
        return START

    def latestOffset(self) -> dict:
        start = last_logged(self.checkpoint)
        admitted = islice(self.log.after(start), self.most) if self.checkpoint else self.log.after(start)
        return max((at for at, _ in admitted), key=lambda o: (o["file"], o["line"]), default=start)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        place = lambda o: (o["file"], o["line"])
        batch = [pin for _, pin in takewhile(lambda x: place(x[0]) <= place(end), self.log.after(start))] if place(start) < place(end) else []
        return [Pins(batch[i : i + self.per_task]) for i in range(0, len(batch), self.per_task)]

    def read(self, partition: Pins) -> Iterator[tuple]:
        yield from map(fetch, partition.pins)


def _registered(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PinnedDocuments)


def pinned(spark: SparkSession, pins: list[dict]) -> DataFrame:
    """The pinned documents.  Predicates on source and url choose the files that are opened; for that the
    session's ``spark.sql.python.filterPushdown.enabled`` is switched on where it isn't set."""
    _registered(spark)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "false":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("pinned_documents").option("pins", json.dumps(pins)).load()


def document_stream(spark: SparkSession, log: str, checkpoint: str, most: int = 10_000, per_task: int = 64, shard: int = 0, shards: int = 1) -> DataFrame:
    """Documents of a pin log as a stream for the query that keeps its state in ``checkpoint``; with ``shards`` those of every so many lines."""
    _registered(spark)
    return spark.readStream.format("pinned_documents").options(path=log, checkpoint=checkpoint, maxDocuments=str(most), perTask=str(per_task), shard=str(shard), shards=str(shards)).load()


def run_documents(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a document stream to the Parquet table at ``path``, batch by batch until the log is read."""
    _run_all([(stream, path, checkpoint)])


def _run_all(runs: list[tuple[DataFrame, str, str]]) -> None:
    started = []
    try:
        for stream, path, checkpoint in runs:
            started.append(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start())
        for q in started:
            q.processAllAvailable()
    finally:
        for q in started:
            q.stop()


#: Streams that read a log side by side.
STREAMS = 4


def run_log(spark: SparkSession, log: str, path: str, checkpoint: str, most: int = 10_000, shards: int = STREAMS) -> DataFrame:
    """The documents of a pin log, read by ``shards`` streams at once, each with a table below ``path``, a state of its own and ``most`` documents a batch.

    Another run goes on where the last one ended, if it has as many shards.
    """
    at = [(f"{path}/{k}", f"{checkpoint}/{k}") for k in range(shards)]
    _run_all([(document_stream(spark, log, state, most, shard=k, shards=shards), table, state) for k, (table, state) in enumerate(at)])
    tables = [spark.read.schema(DOCUMENT).parquet(table) for table, _ in at if file_status(spark, table)]  # a short log leaves some without a batch
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], DOCUMENT)


def document_name(url: Column, suffix: str = "") -> Column:
    """The file name that ``write_documents`` gives a document."""
    return F.concat(F.sha2(url.cast("string"), 256), F.lit(suffix))


def write_documents(docs: DataFrame, folder: str, source: Column, url: Column, content: Column, suffix: str = "") -> str:
    """A file per document below ``folder`` and a pin log of them; returns the log's folder.

    Files are named by the hash of the url, so a task that runs twice writes the same ones.
    """
    ship(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        for b in batches:
            for name, text in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                system.create_dir(f"{root}/documents/{name[:2]}", recursive=True)
                with system.open_output_stream(f"{root}/documents/{name[:2]}/{name}") as f:
                    f.write((text or "").encode())
            path = pa.array([f"{folder}/documents/{n[:2]}/{n}" for n in b.column("name").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("url"), path], ["source", "url", "path"])

    rows = docs.select(source.cast("string").alias("source"), url.cast("string").alias("url"), content.alias("content"), document_name(url, suffix).alias("name"))
    rows.mapInArrow(write, "source string, url string, path string").write.mode("overwrite").json(f"{folder}/pins")
    return f"{folder}/pins"


def corpus_chunks(documents: DataFrame, size: int = 512, overlap: int = 64, least: int = 40) -> DataFrame:
    """chunk_id, source, url, section, token_start, token_end, text of the readable documents."""
    ship(documents.sparkSession)
    html = F.lower(F.substring(F.ltrim("content"), 1, 200)).rlike("<(!doctype html|html)")
    text = F.when(html, files.html_text("content")).when(F.ltrim("content").startswith("<"), files.xml_text("content")).otherwise(F.col("content"))
    read = documents.where("content is not null").select("source", "url", text.alias("text"))
    c = segment.token_chunks(read, ["source", "url"], "text", size, overlap, least)
    return c.select(
        F.concat(X.sha_prefix("url", 10), F.lit("-"), F.lpad(F.col("chunk_no").cast("string"), 5, "0")).alias("chunk_id"), "source", "url", X.section_tag("chunk").alias("section"), "token_start", "token_end", F.col("chunk").alias("text")
    )


def manifests(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """url, source, sha256, n_chars, n_chunks, error per document, and the corpus's hash on each row."""
    n = chunks.groupBy("url").agg(F.count("*").alias("n_chunks"))
    d = documents.join(n, "url", "left").select("url", "source", F.sha2("content", 256).alias("sha256"), F.length("content").alias("n_chars"), F.coalesce("n_chunks", F.lit(0).cast("bigint")).alias("n_chunks"), "error")
    corpus = d.where("sha256 is not null").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), "\n"), 256).alias("corpus_sha256"))  # a hash per pinned document
    return d.crossJoin(corpus)
