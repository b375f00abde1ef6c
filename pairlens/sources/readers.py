"""Readers: formats by suffix, columns by name, labels, raw score documents, append-only logs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import n_words
from ..operators.joins import must_be_empty, unique

SCORED = "query string, query_type string, occupation string, stereotype string, name_pair string, template_style string, perturbation string, score_male double, score_female double, delta double"
RAW = f"model string, mode string, scored_at string, results array<struct<{SCORED.replace(' string', ':string').replace(' double', ':double')}>>"


def pick(columns: list[str], *wanted: str) -> str:
    """The column with one of the wanted names, in any case, exact names before parts of names."""
    low = {c.lower(): c for c in columns}
    for w in wanted:
        if w.lower() in low:
            return low[w.lower()]
    for w in wanted:
        for c in columns:
            if w.lower() in c.lower():
                return c
    raise KeyError(f"none of {wanted} in {columns}")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """csv, tsv, jsonl, ndjson, json (an array, or an object with data, rows or records) or parquet, by suffix."""
    suffix = path.rstrip("/").removesuffix(".gz").rpartition(".")[2].lower()
    if suffix in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="\t" if suffix == "tsv" else ",", quote='"', escape='"', multiLine=True)
    if suffix in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if suffix == "json":
        df = spark.read.json(path, multiLine=True)
        inner = next((c for c in ("data", "rows", "records", "resumes") if c in df.columns and dict(df.dtypes)[c].startswith("array<struct")), None)
        return df.select(F.explode(inner).alias("r")).select("r.*") if inner else df
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format: {path}")


def corpus(df: DataFrame, min_words: int = 60, max_chars: int = 20_000) -> DataFrame:
    """``id, category, text`` of texts of enough words: columns found by name, category in capitals, long texts cut."""
    text, category = pick(df.columns, "text", "resume_str", "resume"), pick(df.columns, "category", "source")
    ident = pick(df.columns, "id", "doc_id") if any("id" in c.lower() for c in df.columns) else None
    key = F.col(ident) if ident else F.sha2(text, 256)
    return df.filter(F.col(text).isNotNull() & (n_words(F.col(text)) >= min_words)).select(key.alias("id"), F.upper(category).alias("category"), F.substring(text, 1, max_chars).alias("text"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Valid labels of a quoted CSV; empty or suppressed numbers are null."""
    df = spark.read.csv(path, header=True, quote='"', escape='"')
    number = lambda c: F.expr(f"try_cast(nullif(nullif(trim({c}), ''), '-') as double)")
    return df.filter(F.col("label").isin("male", "female", "neutral", "drop")).select("occupation", "label", number("pct_women").alias("pct_women"))


def raw_scores(spark: SparkSession, glob: str) -> DataFrame:
    """Scored rows of raw documents, one a model; a model with two documents is an error."""
    docs = spark.read.schema(RAW).json(glob, multiLine=True)
    must_be_empty(unique(docs, "model"), "models with several documents")
    return docs.select("model", F.explode("results").alias("r")).select("model", "r.*")


def score_log(spark: SparkSession, path: str, schema: str, key: list[str], order: str, last: bool = True) -> DataFrame:
    """An append-only JSON-lines log: torn lines are skipped, one line a key stays (the last or the first)."""
    df = spark.read.schema(f"{schema}, _torn string").option("columnNameOfCorruptRecord", "_torn").json(path)
    df = df.filter(F.col("_torn").isNull() & F.col(key[0]).isNotNull()).drop("_torn")
    w = Window.partitionBy(*key).orderBy(F.desc(order) if last else F.asc(order))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def first_existing(spark: SparkSession, what: str, *paths: str, enough: int = 4096) -> str:
    """The first path with more than ``enough`` bytes, else the first that is not empty; in any store that Spark reads."""
    sizes = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        sizes.append(fs.getContentSummary(path).getLength() if fs.exists(path) else 0)
    for least in (enough, 0):
        for p, size in zip(paths, sizes, strict=True):
            if size > least:
                return p
    raise FileNotFoundError(f"{what}: nothing at {', '.join(paths)}")


YEAR_FILE = r"^[A-Za-z]+,[MF],\d+\s*$"  # a line of a headerless name,sex,count file


def _year_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of the year files of zip archives, one file at a time."""
    for batch in batches:
        for content in batch["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for member in z.namelist():
                    if re.match(r"yob\d{4}\.txt$", member.rpartition("/")[2]):
                        yield pd.DataFrame({"value": z.read(member).decode("utf-8", "replace").splitlines()})


def name_genders(spark: SparkSession, path: str, min_confidence: float = 0.95, min_count: int = 200) -> DataFrame:
    """``name, gender, p, count`` of names frequent and one-sided enough.

    From a zip of year files, a headerless name,sex,count file, or a table with a column of names and one of sexes or of
    the women's share (in percent where any value is over 1.5), with counts or without. Lines that cannot be read are left out.
    """
    lines = None
    if path.lower().endswith(".zip"):
        lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_year_lines, "value string")
    else:
        first = spark.read.text(path).limit(1).collect()
        if first and re.match(YEAR_FILE, first[0][0]):
            lines = spark.read.text(path)
    if lines is not None:
        part = F.split(F.trim("value"), ",")
        rows = lines.filter(F.size(part) == 3).select(part[0].alias("name"), F.upper(part[1]).alias("sex"), F.expr("try_cast(split(trim(value), ',')[2] as bigint)").alias("n"))
        rows = rows.select("name", F.when(F.col("sex") == "F", F.col("n")).otherwise(0).alias("f"), F.when(F.col("sex") == "M", F.col("n")).otherwise(0).alias("m"))
    else:
        df = read_rows(spark, path)
        found = lambda *wanted: next((F.col(f"`{c}`").cast("string") for w in wanted for c in df.columns if c.lower() == w), None)
        name, sex, share, n = found("name", "given_name", "first_name"), found("gender", "sex"), found("pct_female", "percent_female", "prob_female", "p_female"), found("count", "n", "births", "frequency")
        if name is None or (sex is None and share is None):
            raise KeyError(f"no columns of names and genders in {df.columns}")
        number = lambda c: c.try_cast("double")
        count = F.floor(F.coalesce(number(n) if share is not None else F.coalesce(number(n), F.lit(1.0)), F.when(n.isNull() | (n == ""), 1.0))) if n is not None else F.lit(1).cast("long")
        if share is not None:
            rows = df.select(name.alias("name"), number(share).alias("x"), count.alias("n"))
            scale = F.when(rows.agg(F.max("x")).scalar() > 1.5, 100.0).otherwise(1.0)
            f = F.bround(F.col("x") / scale * F.col("n")).cast("long")
            rows = rows.select("name", f.alias("f"), (F.col("n") - f).alias("m"))
        else:
            s = F.substring(F.upper(F.trim(sex)), 1, 1)
            rows = df.filter(s.isin("M", "F")).select(name.alias("name"), F.when(s == "F", count).otherwise(0).alias("f"), F.when(s == "M", count).otherwise(0).alias("m"))
    g = rows.filter(F.col("f").isNotNull() & F.col("m").isNotNull()).groupBy(F.lower(F.trim("name")).alias("name")).agg(F.sum("f").alias("f"), F.sum("m").alias("m"))
    p = F.try_divide(F.col("m").cast("double"), F.col("f") + F.col("m"))
    gender = F.when(p >= min_confidence, "M").when(1 - p >= min_confidence, "F")
    return g.filter(F.col("f") + F.col("m") >= min_count).select("name", gender.alias("gender"), F.greatest(p, 1 - p).alias("p"), (F.col("f") + F.col("m")).alias("count")).filter("gender is not null")


def resumed_log(spark: SparkSession, path: str, schema: str, key: list[str], order: str, fingerprint: str, column: str = "sample_hash") -> DataFrame:
    """As ``score_log``, for resuming a run: a line that another configuration or sample wrote is an error."""
    log = score_log(spark, path, schema, key, order)
    must_be_empty(log.filter(~F.col(column).eqNullSafe(F.lit(fingerprint))), f"{path} was written for another sample")
    return log
