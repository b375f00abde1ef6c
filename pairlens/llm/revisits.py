"""Not-modified revisits of a web archive, resolved to the responses they confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The headers that a not-modified answer may update.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical(url: Column) -> Column:
    """Scheme, user, www. and m. hosts, default ports, fragments, a ``ref`` parameter and a last slash do not tell pages apart."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^(?:[^@]*@)?(?:(?:www|m)\.)?", ""), r":(?:80|443)$", "")
    rest = F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(F.regexp_replace(rest, r"([?&])ref=[^&]*&?", "$1"), r"[?&]$", "")
    return F.concat(host, F.regexp_replace(rest, r"/(?=\?|$)", ""))


def resolve_revisits(records: DataFrame, chunk_rows: int = 50_000) -> DataFrame:
    """Every record of kind ``revisit`` with the latest earlier full response of its canonical URL.

    records: ``record_id, kind, url, ts, etag, last_modified, headers`` (map of lower-case names). Returns
    ``record_id, url, response_id, outcome, headers``. outcome: ``resolved``; ``stale`` if a validator that both
    have differs (the ETag first, Last-Modified only where an ETag is missing); ``missing`` without an earlier
    response. headers: of a resolved one the response's, updated by the revisit's permitted ones.

    The as-of join is a running last response in two levels: within pieces of time of about ``chunk_rows``
    records, and over each URL's pieces, so a URL with a third of all records is spread over tasks. Of equal times the
    response comes first; of responses the larger id is later. Null URLs, times or kinds resolve to nothing
    (``missing``); repeated rows give repeated results; empty tables empty ones; other columns are ignored.
    """
    r = records.select("record_id", "kind", canonical(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), "etag", "last_modified", "headers")
    size = r.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    pieces = 1 + size["n"] // chunk_rows
    span = max(1, ((size["hi"] or 0) - (size["lo"] or 0) + pieces) // pieces)
    full = F.struct("ts", "record_id", "etag", "last_modified", "headers")
    r = r.withColumn("piece", F.floor((F.col("ts") - F.lit(size["lo"] or 0)) / F.lit(span))).withColumn("full", F.when(F.col("kind") == "response", full))
    known = r.filter("url is not null and ts is not null")
    last = known.filter("full is not null").groupBy("url", "piece").agg(F.max_by("full", F.struct("ts", "record_id")).alias("last"))
    pieces_of = known.select("url", "piece").distinct().join(last, ["url", "piece"], "left")
    carried = pieces_of.withColumn("before", F.last("last", True).over(Window.partitionBy("url").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    w = Window.partitionBy("url", "piece").orderBy("ts", F.when(F.col("kind") == "response", 0).otherwise(1), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = known.withColumn("within", F.last("full", True).over(w)).filter("kind = 'revisit'").drop("full")
    joined = inside.join(carried, ["url", "piece"]).withColumn("of", F.coalesce("within", "before"))
    lost = r.filter("kind = 'revisit' and (url is null or ts is null)").select("record_id", "url", "etag", "last_modified", "headers").withColumn("of", F.lit(None).cast(joined.schema["of"].dataType))
    found = joined.select("record_id", "url", "etag", "last_modified", "headers", "of").unionByName(lost)
    tags, dates = F.col("etag") == F.col("of.etag"), F.col("last_modified") == F.col("of.last_modified")
    outcome = F.when(F.col("of").isNull(), "missing").when(F.coalesce(tags, dates, F.lit(True)), "resolved").otherwise("stale")
    empty = F.create_map().cast("map<string,string>")
    mine, theirs = F.coalesce("headers", empty), F.coalesce("of.headers", empty)
    update = F.map_filter(mine, lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    out = found.withColumn("outcome", outcome)
    return out.select("record_id", "url", F.when(F.col("outcome") == "resolved", F.col("of.record_id")).alias("response_id"), "outcome", F.when(F.col("outcome") == "resolved", merged).alias("headers"))
