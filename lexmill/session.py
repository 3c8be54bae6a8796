"""Session helpers shared by the whole library."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in tasks are imported there; executors need not have the package installed.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexmill-ship-")) / "lexmill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def file_status(spark: SparkSession, path: str):
    """Hadoop's status of a path, None if there is nothing; works for every store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(at) if fs.exists(at) else None


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths of what lies in a folder, in the order of their names; nothing if there is no folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in store.listStatus(at)) if store.exists(at) else []


def write_new(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a small file; False if it is there already.  One of several writers at most succeeds where the store creates atomically."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(at):
        return False
    try:
        out = store.create(at, False)
    except Exception as e:  # py4j wraps Java's
        if "FileAlreadyExists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made and set for the session, but only in
    local mode: executors of a cluster don't see the driver's own folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def scratch_mark() -> int:
    """Where the list of working tables stands now, for ``drop_scratch``."""
    return len(_made)


def drop_scratch(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the working tables made since the mark ``since``, but those in ``keep``.

    DataFrames that still read them can't be used afterwards, so results are written first.
    """
    for path in [p for p in _made[since:] if p not in keep]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: for what several branches need."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
