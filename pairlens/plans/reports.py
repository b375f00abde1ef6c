"""What reports open with: headline figures, groups by construction, drop reasons, name percentiles, sets of models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import construction, drop_reason, six
from ..operators import shares
from .fixtures import PAIRS, pairs, table
from .registry import query
from .shares import CONTRAST, rounded


@query(f"""WITH {PAIRS}, k AS (SELECT * FROM w WHERE category <> 'drop'), s AS (SELECT model, count(DISTINCT x) AS distinct_scores FROM (SELECT model, unnest([a, b]) AS x FROM k) GROUP BY model),
g AS (SELECT model, count(*) AS n, count(*) FILTER (category = 'a') AS n_a, count(*) FILTER (category = 'b') AS n_b, count(*) FILTER (category = 'neutral') AS n_neutral, round(50.0 * sum(half) / count(*), 6) AS share_a, {CONTRAST},
round(100.0 * count(*) FILTER (a = b) / count(*), 6) AS pct_tie, round(min(least(a, b)), 6) AS least, round(max(greatest(a, b)), 6) AS most, round(avg(abs(d)), 6) AS mean_gap FROM k GROUP BY model)
SELECT g.* EXCLUDE (sa, sb), round(sa - sb, 6) AS contrast, distinct_scores FROM g JOIN s USING (model)""")
def z2_z26_headline(spark, sf):
    return rounded(shares.headline(pairs(spark, sf), "model"), "share_a", "contrast", "pct_tie", "least", "most", "mean_gap")


@query(f"""WITH {PAIRS}, c AS (SELECT *, CASE WHEN template = 'F' THEN 'prepended' WHEN quantity < 25 THEN 'swap_in_window' ELSE 'swap_truncated' END AS built FROM w), t AS (SELECT model, avg(abs(d)) AS g FROM c GROUP BY model)
SELECT model, built, count(*) AS n, count(*) FILTER (a = b) AS n_ties, round(50.0 * sum(half) / count(*), 6) AS share_a, round(avg(abs(d)), 6) AS mean_gap, round(any_value(g) / avg(abs(d)), 6) AS ratio FROM c JOIN t USING (model) GROUP BY ALL""")
def p8_a15_construction(spark, sf):
    mode = F.when(F.col("template") == "F", "inject").otherwise("swap")
    p = pairs(spark, sf).withColumn("built", construction(mode, F.col("quantity") < 25))
    return rounded(shares.construction_stats(p, "built", "model"), "share_a", "mean_gap", "ratio")


@query(f"""WITH {PAIRS}, l AS (SELECT DISTINCT cluster, pct, length(cluster) + pct AS i FROM pairs WHERE category = 'drop')
SELECT cluster, CASE WHEN i % 4 = 0 THEN 'no title' WHEN i % 4 = 1 THEN 'suppressed' ELSE 'ambiguous share' END AS reason FROM l""")
def p12_drop_reason(spark, sf):
    part = pairs(spark, sf).select("cluster", "pct", "category").distinct().filter("category = 'drop'")
    i = (F.length("cluster") + F.col("pct")) % 4
    return part.select("cluster", drop_reason(F.when(i != 0, F.col("cluster")), F.when(i != 1, F.col("pct"))).alias("reason"))


@query("""WITH n AS (SELECT p_brand AS name, p_size % 2 AS gender, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY n DESC, name) - 1 AS place, count(*) OVER (PARTITION BY gender) AS k FROM n)
SELECT name, gender, n, place::INTEGER AS place, round(place / greatest(1, k - 1), 6) AS percentile FROM r""")
def w6_name_percentiles(spark, sf):
    n = table(spark, sf, "part").groupBy(F.col("p_brand").alias("name"), (F.col("p_size") % 2).alias("gender")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("gender")
    r = n.withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "name")) - 1).withColumn("k", F.count(F.lit(1)).over(w))
    return r.select("name", "gender", "n", "place", six(F.col("place") / F.greatest(F.lit(1), F.col("k") - 1)).alias("percentile"))


@query(f"""WITH {PAIRS}, c AS (SELECT query, template, {CONTRAST} FROM w WHERE category IN ('a', 'b') GROUP BY ALL), m AS (SELECT query, max(sa - sb) FILTER (template = 'F') AS x, max(sa - sb) FILTER (template = 'O') AS y FROM c GROUP BY query),
v AS (SELECT 'all' AS variant, * FROM m UNION ALL SELECT 'without_1', * FROM m WHERE query <> 1 UNION ALL SELECT 'without_2_and_3', * FROM m WHERE query NOT IN (2, 3))
SELECT variant, count(*) AS models, round(median(x), 6) AS median_before, round(median(y), 6) AS median_after, count(*) FILTER (y > x) AS n_above, round(median(y - x), 6) AS median_change FROM v GROUP BY variant""")
def a33_without_models(spark, sf):
    c = shares.contrast(pairs(spark, sf), "query", "template")
    m = c.groupBy("query").pivot("template", ["F", "O"]).agg(F.first("contrast"))
    return rounded(shares.set_statistics(m, "query", "F", "O", {"all": [], "without_1": [1], "without_2_and_3": [2, 3]}), "median_before", "median_after", "median_change")


@query("""SELECT l_returnflag AS model, l_linestatus AS category, count(*) AS n FROM lineitem GROUP BY ALL""")
def a34_histogram(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("category")).agg(F.count(F.lit(1)).alias("n"))
