"""Exact tests and least squares, names of a table in texts, documents of differing layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import six
from ..operators import dictionary, exact
from ..sources import layouts
from .fixtures import PAIRS, pairs, table
from .registry import query
from .shares import rounded

CODE = "CASE category WHEN 'a' THEN 1 WHEN 'b' THEN -1 ELSE 0 END"


@query(f"""WITH {PAIRS}, g AS (SELECT model, count(*) AS n, regr_intercept(d, {CODE}) AS intercept, regr_slope(d, {CODE}) AS slope, regr_r2(d, {CODE}) AS r2, regr_sxx(d, {CODE}) AS sxx, regr_syy(d, {CODE}) AS syy FROM pairs GROUP BY model)
SELECT model, n, round(intercept, 6) + 0.0 AS intercept, round(slope, 6) + 0.0 AS slope, round(r2, 6) AS r2, round(r2 / ((1 - r2) / (n - 2)), 4) AS f, round(slope / sqrt(syy * (1 - r2) / (n - 2) / sxx), 4) + 0.0 AS t FROM g""")
def h8_least_squares(spark, sf):
    """The difference on the category's code, by model."""
    p = pairs(spark, sf).withColumn("code", F.expr(CODE))
    got = exact.least_squares(p, "d", ["code"], "model")
    return got.select("model", "n", six(F.col("coefficients")[0]).alias("intercept"), six(F.col("coefficients")[1]).alias("slope"), six(F.col("r2")).alias("r2"), (F.round("f", 4)).alias("f"), (F.round(F.col("t")[1], 4) + F.lit(0.0)).alias("t"))


@query(f"""WITH {PAIRS}, g AS (SELECT model, category, count(d) AS n, avg(d) AS mean, avg(d) / stddev_samp(d) AS d FROM pairs GROUP BY ALL)
SELECT model, category, n, round(mean, 6) + 0.0 AS mean, round(d * sqrt(n), 6) + 0.0 AS t, round(d, 6) + 0.0 AS d, round(d - 1.96 * sqrt(1.0 / n + d * d / (2.0 * n)), 6) + 0.0 AS d_low, round(d + 1.96 * sqrt(1.0 / n + d * d / (2.0 * n)), 6) + 0.0 AS d_high FROM g""")
def h8_cohens_d(spark, sf):
    return rounded(exact.cohens_d(pairs(spark, sf), "d", "model", "category").drop("p"), "mean", "t", "d", "d_low", "d_high")


@query()
def h8_wilcoxon_exact(spark, sf):
    """Exact signed-rank p of each brand's lines of one supplier, where there are at most 200; null beyond."""
    return rounded(exact.wilcoxon_exact(pairs(spark, sf), "d", "model", "cluster", "suppkey"), "w_plus", "p")


@query("""WITH d AS (SELECT doc_id, coalesce(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Z][a-z]+'), lambda x: lower(x)), lambda x: length(x) > 3)), []) AS seen, regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+') AS words FROM documents),
n AS (SELECT DISTINCT lower(regexp_extract(text, '^([A-Z][a-z]+)', 1)) AS name FROM documents WHERE length(regexp_extract(text, '^([A-Z][a-z]+)', 1)) > 3), f AS (SELECT doc_id, w, lower(w) AS t FROM (SELECT doc_id, unnest(words) AS w FROM d) JOIN n ON lower(w) = name),
l AS (SELECT doc_id, list(DISTINCT t) AS listed FROM f WHERE length(t) > 3 GROUP BY doc_id), b AS (SELECT seen, coalesce(listed, []) AS listed FROM d LEFT JOIN l USING (doc_id)),
x AS (SELECT count(*) AS texts, sum(len(list_intersect(listed, seen)))::BIGINT AS tp, sum(len(listed) - len(list_intersect(listed, seen)))::BIGINT AS fp, sum(len(seen) - len(list_intersect(listed, seen)))::BIGINT AS fn, count(*) FILTER (len(seen) > 0 AND len(list_intersect(listed, seen)) > 0) AS texts_hit, count(*) FILTER (len(seen) > 0) AS texts_with FROM b)
SELECT texts, tp, fp, fn, texts_hit, texts_with, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp + fn), 6) AS jaccard FROM x""")
def f15_z16_z17_dictionary(spark, sf):
    """A table of names, the words that documents begin with, against the capitalised words of all documents."""
    d = table(spark, sf, "documents")
    names = d.select(F.regexp_extract("text", "^([A-Z][a-z]+)", 1).alias("name")).filter(F.length("name") > 3).select(F.lower("name").alias("name")).distinct()
    found = dictionary.found_names(d, names)
    low = lambda c: F.array_distinct(F.filter(F.transform(c, F.lower), lambda x: F.length(x) > 3))
    seen = d.select("doc_id", F.coalesce(low(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))), F.array().cast("array<string>")).alias("seen"))
    both = found.select("doc_id", low("names").alias("listed")).join(seen, "doc_id")
    return rounded(dictionary.agreement(both, "listed", "seen"), "precision", "recall", "jaccard")


@query("""SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS missing, count(DISTINCT json_extract(props, '$.k')::BIGINT) AS kinds FROM events GROUP BY event_type""")
def s11_s14_z44_variant_props(spark, sf):
    """Properties of events as VARIANT: the first of several paths that is there, typed."""
    e = table(spark, sf, "events").select("event_type", F.parse_json("props").alias("doc"))
    k = e.withColumn("k", layouts.at("doc", "long", "$.key.value", "$.k"))
    return k.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.count_if(F.col("k").isNull()).alias("missing"), F.count_distinct("k").alias("kinds"))
