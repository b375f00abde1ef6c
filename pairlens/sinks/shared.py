"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, tuple] = {}  # by application: the folder's file system and path, kept for the end


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session or the context's checkpoint folder; with neither, a temporary folder, on ``local[...]`` only."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="spark-pairlens-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once, the same rows for every later step, also when an executor is lost.

    The application's tables are deleted when the driver ends, also after its session was stopped.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/pairlens-kept/{app}"
    if app not in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        _made[app] = (path.getFileSystem(spark._jsc.hadoopConfiguration()), path)
        atexit.register(sweep, app)
    at = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def sweep(app: str) -> None:
    if app in _made:
        fs, path = _made.pop(app)
        fs.delete(path, True)
