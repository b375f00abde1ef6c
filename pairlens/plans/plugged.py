"""User-given scorers and detectors on the provided tables: deterministic stand-ins for models."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions import plugged
from ..operators.cache import DetectionCache
from ..sinks.shared import shared_dir
from .fixtures import table
from .registry import query


@query("""WITH r AS (SELECT role, text FROM conversations WHERE text IS NOT NULL) SELECT role, count(*) AS n, sum(length(role) * 1000 + length(text))::BIGINT AS total FROM r GROUP BY role""")
def s24_s26_scorer(spark, sf):
    c = table(spark, sf, "conversations").filter("text is not null").select("role", "text")
    got = plugged.scored(c, "role", "text", lambda q, d: q.str.len() * 1000.0 + d.str.len())
    return got.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("score").cast("long").alias("total"))


@query()
def z38_z47_detector(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", plugged.detected(F.col("text"), lambda t: re.findall(r"\b[A-Z][a-z]{3,}\b", t)).alias("names")).select("doc_id", F.size("names").alias("n_names"), F.get("names", 0).alias("longest"))


@query("""WITH w AS (SELECT doc_id, text, list_distinct(flatten(list_transform(range(0, greatest(length(text) - 1, 0) + 1, 1100), lambda i: regexp_extract_all(substr(text, (i + 1)::BIGINT, 1200), '[A-Z][a-z]{3,}')))) AS names FROM documents)
SELECT doc_id, coalesce(len(names), -1)::INTEGER AS n_names, list_sort(list_transform(names, lambda x: {'n': -length(x), 'x': x}))[1].x AS longest, text IS NOT NULL AND text IN (SELECT text FROM documents WHERE lang = 'en') AS from_cache FROM w""")
def s15_z38_cached_detection(spark, sf):
    """A second run over all documents after one over the English ones: only texts that are new to it meet the detector."""
    docs = table(spark, sf, "documents")
    cache = DetectionCache(spark, f"{shared_dir(spark)}/detections-{uuid.uuid4().hex}", "capitalised words")
    detect = lambda t: re.findall("[A-Z][a-z]{3,}", t)
    cache.add(docs.filter("lang = 'en'"), detect)
    before = cache.known().select(F.col("sha").alias("__had"))
    had = docs.join(before, F.sha2("text", 256) == F.col("__had"), "left").select("doc_id", "text", F.col("__had").isNotNull().alias("from_cache"))
    got = cache.names(had, detect)
    return got.select("doc_id", F.coalesce(F.size("names"), F.lit(-1)).alias("n_names"), F.get("names", 0).alias("longest"), "from_cache")
