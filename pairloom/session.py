"""Session settings the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession, batch_bytes: int = 16 << 20) -> None:
    """Give the executors' Python workers this package, once per application.

    Batches for them are held to ``batch_bytes``, unless the application names a size itself: whole texts
    are long, and each task has a batch in the JVM and one in its worker.
    """
    context = spark.sparkContext
    if not context.getConf().contains(ARROW_BYTES):
        spark.conf.set(ARROW_BYTES, str(batch_bytes))
    if context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="pairloom-package-")
        root, name = os.path.split(PACKAGE)
        context.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", root, name))
        _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may run without the setting; it then gets a
    new folder of its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return folder
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the application's folder in the shared one.

    The application owns that folder; it goes when the driver ends, through the same
    file system that holds it.
    """
    context = spark.sparkContext
    own = f"{shared_folder(spark).rstrip('/')}/tables-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs in here go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, purpose: str, lean: bool = False) -> DataFrame:
    """The frame written to a fresh table in the shared folder and read back.

    For results that several later jobs read: they are worked out once, and losing an
    executor costs a re-read, not the lineage. ``lean`` is for large ones: nothing but the table
    stays on disk, and that is compressed more.
    """
    path = new_folder(df.sparkSession, purpose)
    if lean:
        with shuffles_end(df.sparkSession):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``stored`` made, once no frame reads it any more."""
    spark = df.sparkSession
    own = f"/tables-{spark.sparkContext.applicationId}/"
    folders = {f[:f.rindex("/")] for f in df.inputFiles()}
    for folder in folders:
        if own not in folder:
            raise ValueError(f"not a table of this application: {folder}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
