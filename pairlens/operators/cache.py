"""What a slow detector found, kept by content: only texts that no run has seen meet it."""

from __future__ import annotations

import json
from hashlib import md5

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plugged import Detector, detected

SCHEMA = "sha string, names array<string>, settings string"


class DetectionCache:
    """An append-only table of (settings, SHA-256 of the text, names).

    ``settings`` is all that the answers depend on besides the text: the detector's name, its parameters, the windows. Another value
    reads other rows, so stale answers are never served, and old ones stay for who still needs them. A run adds the texts that are
    new to it by one committed write; if it is lost before that, nothing was added, and if two runs add the same text, one row is read.
    """

    def __init__(self, spark: SparkSession, path: str, detector: str, window: int = 1200, overlap: int = 100, **settings) -> None:
        self.spark, self.path, self.window, self.overlap = spark, path, window, overlap
        said = json.dumps({"detector": detector, "window": window, "overlap": overlap, **settings}, sort_keys=True)
        self.settings = md5(said.encode()).hexdigest()

    def known(self) -> DataFrame:
        """``sha, names`` under these settings, each text once. Only the settings' own folder is read."""
        try:
            held = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:  # the first run
            held = self.spark.createDataFrame([], SCHEMA)
        return held.filter(F.col("settings") == self.settings).select("sha", "names").dropDuplicates(["sha"])

    def unseen(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``sha, text`` of the distinct texts that the table lacks; a null text has no names and is never asked for."""
        texts = docs.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("sha"), F.col(text).alias("text"))
        return texts.join(self.known().select("sha"), "sha", "left_anti").dropDuplicates(["sha"])

    def add(self, docs: DataFrame, detect: Detector, text: str = "text") -> None:
        """Runs the detector over the unseen texts and appends what it finds; writes nothing if there are none."""
        new = self.unseen(docs, text)
        if not new.isEmpty():
            found = new.select("sha", detected(F.col("text"), detect, self.window, self.overlap).alias("names"), F.lit(self.settings).alias("settings"))
            found.write.mode("append").partitionBy("settings").parquet(self.path)

    def names(self, docs: DataFrame, detect: Detector, text: str = "text", out: str = "names") -> DataFrame:
        """``docs`` with the names of every text, from the table alone once ``add`` has filled it; null text, null names."""
        self.add(docs, detect, text)
        return docs.withColumn("__sha", F.sha2(text, 256)).join(self.known().select(F.col("sha").alias("__sha"), F.col("names").alias(out)), "__sha", "left").drop("__sha")
