"""What the operators of this subpackage share: table reading and materialised intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session, or the context's checkpoint folder.

    Only where neither is set and driver and executors are one process (``local[...]``, as in tests) a temporary folder
    is made and set; on a cluster that is an error, as executors would write to their own disks.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="spark-pairlens-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


_folders: dict[str, tuple] = {}  # of this driver's applications, with what deletes them after the session has ended


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: what was computed once is not computed again when an executor is lost or when
    two later steps read it, and both read the very same rows. The table lives until ``discard`` or the driver's end.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/pairlens/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders[folder] = _hadoop(spark)
        atexit.register(_sweep, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of several tables made by ``written``, of one schema, as one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t.written_path for t in tables])


def _hadoop(spark: SparkSession) -> tuple:
    return spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()


def _delete(hadoop: tuple, path: str) -> None:
    jvm, settings = hadoop
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(settings).delete(folder, True)


def _sweep(folder: str) -> None:
    """At the driver's end: all tables of the application, whether or not the session was stopped before."""
    try:
        _delete(_folders.pop(folder), folder)
    except (Py4JError, OSError):  # the JVM has ended already
        pass


@contextmanager
def small_batches(spark: SparkSession, rows: int, mb: int | None = None) -> Iterator[None]:
    """What is written inside gets its rows in Python in batches of at most ``rows``, and of some ``mb``: of texts, ten thousand are tens of MB, held twice outside Spark's own memory."""
    records, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {name: spark.conf.get(name) for name in (records, size)}
    spark.conf.set(records, str(min(rows, int(before[records])) if int(before[records]) > 0 else rows))
    if mb:
        spark.conf.set(size, f"{mb}m")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside removes its shuffle files as soon as it is written, not at the driver's next collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files and broadcast tables of finished, written steps now, not at the driver's next collection; unused memory goes back."""
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` once all that is made from them is written itself."""
    for df in tables:
        _delete(_hadoop(df.sparkSession), df.written_path)
