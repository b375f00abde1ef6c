"""JSON documents of differing layouts as VARIANT: one read for all, typed columns from the first path that a document has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, *paths: str) -> DataFrame:
    """``file, doc``: each file, plain or gzipped, as one VARIANT value, whatever its layout. A file that is no JSON is an error."""
    read = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("singleVariantColumn", "doc")
    return read.json(list(paths)).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"), "doc")


def at(doc: Column | str, kind: str, *paths: str) -> Column:
    """The value of the first path that is there, as ``kind``; null where none is, or where it is no ``kind``."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    return F.coalesce(*[F.try_variant_get(doc, p, kind) for p in paths])


def needed(doc: Column | str, kind: str, *paths: str, where: Column | None = None) -> Column:
    """As ``at``, but a document with none of the paths stops the job and is named."""
    said = F.concat(F.lit(f"unresolved path: none of {', '.join(paths)} as {kind}"), F.lit(" in ") if where is not None else F.lit(""), where if where is not None else F.lit(""))
    return F.coalesce(at(doc, kind, *paths), F.raise_error(said).cast(kind))


def entries(doc: Column | str, *paths: str, name: str = "$.model") -> Column:
    """(key, value) of an object's members, or of an array's objects by what each says at ``name``: the two ways to write a keyed list."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    members = F.map_entries(at(doc, "map<string,variant>", *paths))
    listed = F.transform(at(doc, "array<variant>", *paths), lambda v: F.struct(F.try_variant_get(v, name, "string").alias("key"), v.alias("value")))
    return F.coalesce(members, listed)


ROW = {
    "pool_id": ("string", ("$.pool_id", "$.pool")),
    "focal_index": ("int", ("$.focal_index", "$.focal", "$.index")),
    "score_male": ("double", ("$.score_male", "$.scores.male", "$.scores[0]")),
    "score_female": ("double", ("$.score_female", "$.scores.female", "$.scores[1]")),
}


def scored_rows(rows: DataFrame, fields: dict[str, tuple[str, tuple[str, ...]]] = ROW) -> DataFrame:
    """``file, hash, model`` and typed columns of row documents, either ``models: {name: {rows: []}}`` or ``model`` and ``rows`` at the top."""
    d = rows.select("file", at("doc", "string", "$.pool_membership_sha256", "$.provenance.pools").alias("hash"), "doc")
    many = d.select("file", "hash", F.explode(entries("doc", "$.models")).alias("m")).select("file", "hash", "m.key", F.col("m.value").alias("v"))
    one = d.filter(at("doc", "variant", "$.models").isNull()).select("file", "hash", needed("doc", "string", "$.model", where=F.col("file")).alias("key"), F.col("doc").alias("v"))
    each = many.unionByName(one).select("file", "hash", F.col("key").alias("model"), F.explode(needed("v", "array<variant>", "$.rows", "$.comparisons", where=F.col("file"))).alias("row"))
    return each.select("file", "hash", "model", *[needed("row", kind, *paths, where=F.col("file")).alias(c) for c, (kind, paths) in fields.items()])


def run(summaries: DataFrame, rows: DataFrame, fields: dict[str, tuple[str, tuple[str, ...]]] = ROW) -> DataFrame:
    """The scored rows of runs: each summary's models with the rows file that it names.

    Rows and summary have to come from the same pools: another hash stops the job, as does a rows file that is not there.
    """
    s = summaries.select("file", needed("doc", "string", "$.provenance.sampling.pool_membership_sha256", "$.pool_membership_sha256", where=F.col("file")).alias("expected"), F.explode(entries("doc", "$.models")).alias("m"))
    named = F.regexp_extract(needed("m.value", "string", "$.rows_file", "$.rows", where=F.col("summary")), "([^/]+)$", 1)
    s = s.withColumnRenamed("file", "summary").select("summary", "expected", F.col("m.key").alias("model"), named.alias("file"))
    got = s.join(scored_rows(rows, fields), ["file", "model"], "left")
    wrong = F.when(F.col("hash").isNull(), F.lit("has no rows for")).when(F.col("hash") != F.col("expected"), F.lit("and its summary come from different pools:"))
    stop = F.raise_error(F.concat_ws(" ", F.col("file"), wrong, F.col("model"), F.col("summary"))).cast("boolean")
    return got.filter(F.when(wrong.isNull(), F.lit(True)).otherwise(stop)).drop("hash", "expected", "file")


def condition(docs: DataFrame, **expected: object) -> DataFrame:
    """Documents that are the condition they should be: ``path__inside`` names a path, ``None`` means absent or false; another value stops the job."""
    ok = F.lit(True)
    for path, value in expected.items():
        p = "$." + path.replace("__", ".")
        if value is None or value is False:
            ok = ok & ~F.coalesce(at("doc", "boolean", p), F.lit(False))
        else:
            kind = {bool: "boolean", int: "long", float: "double", str: "string"}[type(value)]
            ok = ok & F.coalesce(at("doc", kind, p) == F.lit(value), F.lit(False))
    stop = F.raise_error(F.concat(F.col("file"), F.lit(": not the condition its name says"))).cast("boolean")
    return docs.filter(F.when(ok, F.lit(True)).otherwise(stop))
