"""A rendered table read back for the order of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ESCAPED = r"\\([&%$#_])"


def table_rows(spark: SparkSession, path: str) -> DataFrame:
    """``place, cells`` of a rendered table's rows: lines with ``&``, cells trimmed and unescaped. One file is one table."""
    line = F.posexplode(F.split("value", r"\r?\n")).alias("place", "line")
    rows = spark.read.text(path, wholetext=True).select(line).filter(F.col("line").rlike(r"(?<!\\)&"))
    body = F.regexp_replace("line", r"\s*\\\\(\[[^\]]*\])?\s*(\\hline)?\s*$", "")
    cells = F.transform(F.split(body, r"(?<!\\)&"), lambda c: F.regexp_replace(F.trim(c), ESCAPED, "$1"))
    return rows.select("place", cells.alias("cells"))


def ordered_as(models: DataFrame, rendered: DataFrame | None, key: str, label: str, fallback: str) -> DataFrame:
    """``models`` with ``place`` (from 1) and ``source``: as their labels stand in the table, if it has each just once, else by ``fallback``, largest first.

    For tables of results: the models are few.
    """
    w = Window.partitionBy(F.lit(0))
    m = models.withColumn("__by", F.row_number().over(w.orderBy(F.desc(fallback), key)))
    if rendered is None:
        return m.withColumnRenamed("__by", "place").withColumn("source", F.lit(fallback))
    seen = rendered.groupBy(F.col("cells")[0].alias("__label")).agg(F.min("place").alias("__at"), F.count(F.lit(1)).alias("__times"))
    j = m.join(seen, F.col(label) == F.col("__label"), "left")
    whole = F.min(F.coalesce(F.col("__times") == 1, F.lit(False))).over(w)
    place = F.row_number().over(w.orderBy("__at"))
    return j.withColumn("__p", place).withColumn("__w", whole).select(*models.columns, F.when(F.col("__w"), F.col("__p")).otherwise(F.col("__by")).alias("place"), F.when(F.col("__w"), "table").otherwise(fallback).alias("source"))
