"""Shared scratch storage, and shipping of this package to the executors.

Intermediate tables are written as Parquet under ``spark.checkpoint.dir`` (the
folder that driver and executors share) and read back, which cuts the lineage
and survives the loss of an executor. Only where that setting is unset, as in
tests with a local master, a temporary folder of the driver is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: str | None = None
_shipped: set[str] = set()
_folders: set[str] = set()


def root(spark: SparkSession) -> str:
    """The URI of the folder that driver and executors share."""
    global _own_root
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{_own_root}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one table or folder of files; this application's are deleted when its driver ends."""
    folder = f"{root(spark)}/lodestone-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session may be stopped by then; what it left stays
        hadoop_delete(spark, folder)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a scan of those files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows while the body runs its jobs: for rows that are lists of whole sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by ``materialise`` that nothing reads any more."""
    paths = {os.path.dirname(f) for f in df.inputFiles()}
    for path in paths:
        if "/lodestone-" in path:
            hadoop_delete(df.sparkSession, path)


def hadoop_delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def filesystem(uri: str):
    """(file system, path) for binary files that Python tasks write and read themselves."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


#: Rows of one Arrow batch, at most: texts can be long, and both sides hold a batch whole.
BATCH_ROWS = 1000
#: Ids that an anti-join may broadcast, at most; beyond it the join is a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` isn't in ``ids(doc_id)``; rows with a null one stay."""
    ids = materialise(ids.where("doc_id is not null").distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    return docs.join(ids, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers on other machines, and bound their batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="lodestone-ship-"), "lodestone_ship.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, files in os.walk(top):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join("lodestone", os.path.relpath(full, top)))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark
