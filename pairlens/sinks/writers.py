"""Writers. Spark's commit protocol replaces temporary files, renames and locks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, path: str, compress: bool = True, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "gzip" if compress else "none").json(path)


def csv_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds JSON lines; readers keep one line a key."""
    df.write.mode("append").json(path)


def nested(df: DataFrame, *by: str) -> DataFrame:
    """Tidy rows as one JSON document for each group."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rest)))).alias("document"))


def once(df: DataFrame, path: str) -> DataFrame:
    """A sidecar table written the first time and read ever after."""
    from pyspark.errors import AnalysisException

    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException:
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
