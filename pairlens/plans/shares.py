"""Shares, contrasts and what is read off them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import band, bias_label, direction, six, winner
from ..operators import blocks, resample, shares
from .fixtures import BAND, HALF, H, PAIRS, pairs
from .registry import query

SIX = lambda *cols: ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


def rounded(df, *cols):
    return df.select([six(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


DRAWS = 1000


def interval_sql(key: str, stratum: str, table: str, draws: int, seed: str, by: str) -> str:
    """CTEs few, drawn, times: the SQL twin of ``resample.weights`` for one stratum column."""
    h = H.format(f"'{seed}|' || {by} || '|' || b || '|' || j")
    return f"""few AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY {key}) - 1 AS j, count(*) OVER (PARTITION BY {stratum}) AS k FROM (SELECT DISTINCT {stratum}, {key} FROM {table})),
drawn AS (SELECT {stratum}, b, {h} % k AS j FROM few, range({draws}) t(b)),
times AS (SELECT f.{stratum}, b, {key}, count(*) AS times FROM drawn d JOIN few f ON f.{stratum} = d.{stratum} AND f.j = d.j GROUP BY ALL)"""


@query(f"""WITH {PAIRS}, c AS (SELECT category, cluster, count(*) AS n, sum(half)::BIGINT AS half FROM w GROUP BY ALL),
{interval_sql('cluster', 'category', 'c', 1000, 'share', 'category')},
v AS (SELECT t.category, b, 50.0 * sum(times * half) / sum(times * n) AS value FROM times t JOIN c USING (category, cluster) GROUP BY ALL),
p AS (SELECT category, 50.0 * sum(half) / sum(n) AS point, count(*) AS clusters FROM c GROUP BY ALL)
SELECT category, round(point, 6) AS point, clusters, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(stddev_samp(value), 6) AS sd,
round(100.0 * count(*) FILTER (value > 0) / count(value), 6) AS pct_positive FROM p JOIN v USING (category) GROUP BY ALL""")
def a1_cluster_win_shares(spark, sf):
    """Tie-aware share by category with a cluster bootstrap interval: the flagship."""
    sums = shares.cluster_sums(pairs(spark, sf), "category", "cluster")
    got = resample.ratio_bootstrap(sums, "half", "n", "cluster", 1000, "share", "category", scale=50.0)
    return rounded(got, "point", "low", "high", "sd", "pct_positive")


WIN = f"""count(*) AS n, count(DISTINCT cluster) AS n_clusters, round(100.0 * count(*) FILTER (a > b) / count(*), 6) AS pct_a, round(100.0 * count(*) FILTER (a = b) / count(*), 6) AS pct_tie,
round(50.0 * sum({HALF}) / count(*), 6) AS share_a,
round(100.0 * count(*) FILTER ((category = 'a' AND a > b) OR (category = 'b' AND a < b)) / nullif(count(*) FILTER (category IN ('a', 'b')), 0), 6) AS match_rate,
round(100.0 * (count(*) FILTER ((category = 'a' AND a > b) OR (category = 'b' AND a < b)) + 0.5 * count(*) FILTER (category IN ('a', 'b') AND a = b)) / nullif(count(*) FILTER (category IN ('a', 'b')), 0), 6) AS match_rate_tie_aware"""
WIN_COLS = ("pct_a", "pct_tie", "share_a", "match_rate", "match_rate_tie_aware")


@query(f"WITH {PAIRS} SELECT model, {WIN} FROM pairs GROUP BY model")
def a1_win_shares_by_model(spark, sf):
    return rounded(shares.win_shares(pairs(spark, sf), "model"), *WIN_COLS)


@query(f"WITH {PAIRS} SELECT model, cluster, {WIN} FROM pairs GROUP BY ALL")
def a2_per_cluster(spark, sf):
    return rounded(shares.win_shares(pairs(spark, sf).withColumn("c2", F.col("cluster")), "model", "cluster", cluster="c2"), *WIN_COLS)


@query(f"WITH {PAIRS} SELECT model, category, {WIN} FROM pairs GROUP BY ALL")
def a1_by_category(spark, sf):
    return rounded(shares.win_shares(pairs(spark, sf), "model", "category"), *WIN_COLS)


@query(f"WITH {PAIRS} SELECT model, template, query, {WIN} FROM pairs GROUP BY ALL")
def a1_by_stratum(spark, sf):
    return rounded(shares.win_shares(pairs(spark, sf), "model", "template", "query"), *WIN_COLS)


@query(f"WITH {PAIRS} SELECT model, category, count(*) AS n, round(50.0 * sum(half) / count(*), 6) AS share_a FROM w GROUP BY ROLLUP (model, category)")
def a4_rolled_up_shares(spark, sf):
    return rounded(shares.rolled_up(pairs(spark, sf), "model", "category"), "share_a")


@query(f"""WITH {PAIRS} SELECT model, winner, count(*) AS n FROM (SELECT model, CASE WHEN a > b THEN 'a' WHEN a < b THEN 'b' ELSE 'tie' END AS winner FROM pairs) GROUP BY ALL""")
def a3_p4_winner_counts(spark, sf):
    p = pairs(spark, sf)
    return p.groupBy("model", winner(F.col("a"), F.col("b")).alias("winner")).agg(F.count(F.lit(1)).alias("n"))


CONTRAST = """50.0 * sum(half) FILTER (category = 'a') / count(*) FILTER (category = 'a') AS sa, 50.0 * sum(half) FILTER (category = 'b') / count(*) FILTER (category = 'b') AS sb"""


@query(f"WITH {PAIRS}, g AS (SELECT model, {CONTRAST} FROM w WHERE category IN ('a', 'b') GROUP BY model) SELECT model, round(sa, 6) AS share_a_typed, round(sb, 6) AS share_b_typed, round(sa - sb, 6) AS contrast FROM g")
def a5_contrast(spark, sf):
    return rounded(shares.contrast(pairs(spark, sf), "model"), "share_a_typed", "share_b_typed", "contrast")


@query(f"""WITH {PAIRS}, g AS (SELECT model, query, {CONTRAST} FROM w WHERE category IN ('a', 'b') GROUP BY ALL)
SELECT model, count(*) AS levels, count(*) FILTER (sa - sb > 0) AS positive, bool_and(sa - sb > 0) AS all_positive, round(min(sa - sb), 6) AS least, round(max(sa - sb), 6) AS most FROM g GROUP BY model""")
def a11_stratum_contrasts(spark, sf):
    return rounded(shares.stratum_contrasts(pairs(spark, sf), "model", "query"), "least", "most")


@query(f"""WITH {PAIRS}, s AS (SELECT model, query, 50.0 * sum(half) / count(*) AS share FROM w GROUP BY ALL)
SELECT count(*) AS n, round(avg(share), 6) AS mean, round(median(share), 6) AS median, round(min(share), 6) AS least, round(max(share), 6) AS most, count(*) FILTER (share > 50) AS above, count(*) FILTER (share < 50) AS below, count(*) FILTER (share = 50) AS even FROM s""")
def a16_across(spark, sf):
    s = shares.cluster_sums(pairs(spark, sf), "model", "query").withColumn("share", shares.share(F.col("half"), F.col("n")))
    return rounded(shares.across(s, "share"), "mean", "median", "least", "most")


@query(f"""WITH {PAIRS}, s AS (SELECT model, name, 50.0 * sum(half) / count(*) AS s FROM w GROUP BY ALL), r AS (SELECT max(s) - min(s) AS r FROM s GROUP BY model)
SELECT round(median(r), 6) AS median_range, round(max(r), 6) AS max_range FROM r""")
def a17_spread(spark, sf):
    return rounded(shares.spread(pairs(spark, sf), "model", "name"), "median_range", "max_range")


@query(f"""WITH {PAIRS}, s AS (SELECT model, cluster, category, 50.0 * sum(half) / count(*) AS s FROM w GROUP BY ALL)
SELECT model, category, count(*) AS clusters, count(*) FILTER ((category = 'a' AND s > 50) OR (category = 'b' AND s < 50)) AS as_expected, count(*) FILTER (s = 50) AS even FROM s GROUP BY ALL""")
def a19_consistency(spark, sf):
    return shares.consistency(pairs(spark, sf), "model")


@query(f"""WITH {PAIRS}, v AS (SELECT model, half, 'bands' AS view, category FROM w UNION ALL SELECT model, half, 'halves', CASE WHEN pct < 50 THEN 'b' ELSE 'a' END FROM w
UNION ALL SELECT model, half, 'narrow', CASE WHEN pct < 25 THEN 'b' WHEN pct > 75 THEN 'a' ELSE 'drop' END FROM w)
SELECT view, model, category, count(*) AS n, round(50.0 * sum(half) / count(*), 6) AS share_a FROM v WHERE category <> 'drop' GROUP BY ALL""")
def a18_label_views(spark, sf):
    pct = F.col("pct")
    views = {"bands": band(pct), "halves": F.when(pct < 50, "b").otherwise("a"), "narrow": F.when(pct < 25, "b").when(pct > 75, "a").otherwise("drop")}
    return rounded(shares.label_views(pairs(spark, sf), views), "share_a")


@query(f"""WITH {PAIRS}, cuts(low, high) AS (VALUES (30, 70), (25, 75), (35, 65)), g AS (SELECT model, low, high, half, CASE WHEN pct < low THEN 'b' WHEN pct > high THEN 'a' ELSE 'x' END AS category FROM w, cuts)
SELECT model, low, high, round(50.0 * sum(half) FILTER (category = 'a') / count(*) FILTER (category = 'a') - 50.0 * sum(half) FILTER (category = 'b') / count(*) FILTER (category = 'b'), 6) AS contrast FROM g GROUP BY ALL""")
def p7_other_cutoffs(spark, sf):
    return rounded(shares.cutoffs(pairs(spark, sf), [(30, 70), (25, 75), (35, 65)]), "contrast")


@query(f"""WITH {PAIRS} SELECT model, category, template, GROUPING(model, category, template)::BIGINT AS level, count(*) AS n, count(*) FILTER (a > b) AS wins FROM pairs
GROUP BY GROUPING SETS ((), (model), (category), (template), (model, category))""")
def a12_grouping_sets(spark, sf):
    return shares.subsets(pairs(spark, sf), [[], ["model"], ["category"], ["template"], ["model", "category"]], F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > F.col("b")).alias("wins")).select(
        "model", "category", "template", "level", "n", "wins"
    )


@query(f"""WITH {PAIRS} SELECT model, count(d) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(median(d), 6) + 0.0 AS median, round(avg(d) / stddev_samp(d), 6) AS cohen_d,
round((avg(d*d*d) - 3*avg(d)*avg(d*d) + 2*avg(d)**3) / pow(avg(d*d) - avg(d)**2, 1.5), 6) AS skew, round(kurtosis_pop(d), 6) AS excess_kurtosis, round(avg(abs(d)), 6) AS mean_gap, round(quantile_cont(abs(d), 0.95), 6) AS p95_gap,
round(max(abs(d)), 6) AS max_gap, round(100.0 * count(*) FILTER (d = 0) / count(d), 6) AS pct_zero FROM pairs GROUP BY model""")
def a6_a7_a30_moments(spark, sf):
    return rounded(shares.moments(pairs(spark, sf), "model"), "mean", "sd", "median", "cohen_d", "skew", "excess_kurtosis", "mean_gap", "p95_gap", "max_gap", "pct_zero")


@query(f"WITH {PAIRS}, c AS (SELECT model, cluster, sum(abs(d)) AS s, count(*) AS n FROM pairs GROUP BY ALL) SELECT model, round(sum(s) / sum(n), 6) AS mean_gap, count(*) AS clusters FROM c GROUP BY model")
def a8_cluster_mean_gap(spark, sf):
    c = pairs(spark, sf).groupBy("model", "cluster").agg(F.sum(F.abs("d")).alias("s"), F.count(F.lit(1)).alias("n"))
    return c.groupBy("model").agg(six(F.sum("s") / F.sum("n")).alias("mean_gap"), F.count(F.lit(1)).alias("clusters"))


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, count(*) AS n FROM pairs WHERE a > b GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY model) AS p FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p DESC) AS r FROM p)
SELECT model, round(1 / sum(p * p), 6) AS effective, round(sum(p) FILTER (r <= 3), 6) AS top3, count(*) AS holders FROM r GROUP BY model""")
def a24_occupancy(spark, sf):
    c = pairs(spark, sf).filter("a > b").groupBy("model", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return rounded(shares.occupancy(c, "n", "model"), "effective", "top3")


@query(f"""WITH {PAIRS}, s AS (SELECT model, cluster, 1.0 * sum(half) / (2 * count(*)) AS share FROM w GROUP BY ALL)
SELECT model, cluster, round(share, 6) AS share, CASE WHEN share >= 0.75 THEN 'strong' WHEN share >= 0.65 THEN 'moderate' WHEN share >= 0.55 THEN 'weak' ELSE 'none' END AS label, row_number() OVER (PARTITION BY model ORDER BY share DESC, cluster)::INTEGER AS place FROM s""")
def z46_findings(spark, sf):
    from pyspark.sql import Window

    s = shares.cluster_sums(pairs(spark, sf), "model", "cluster").withColumn("share", F.col("half") / (2 * F.col("n")))
    return s.select("model", "cluster", six(F.col("share")).alias("share"), bias_label(F.col("share")).alias("label"), F.row_number().over(Window.partitionBy("model").orderBy(F.desc("share"), "cluster")).alias("place"))


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, category, sum(half)::BIGINT AS half, count(*) AS n FROM w WHERE category IN ('a', 'b') GROUP BY ALL), {interval_sql('cluster', 'category', 'c', DRAWS, 'contrast', 'category')},
v AS (SELECT model, b, 50.0 * sum(times * half) FILTER (c.category = 'a') / sum(times * n) FILTER (c.category = 'a') - 50.0 * sum(times * half) FILTER (c.category = 'b') / sum(times * n) FILTER (c.category = 'b') AS value
FROM times t JOIN c ON t.category = c.category AND t.cluster = c.cluster GROUP BY ALL)
SELECT model, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(stddev_samp(value), 6) AS sd, round(100.0 * count(*) FILTER (value > 0) / count(value), 6) AS pct_positive FROM v GROUP BY model""")
def b2_contrast_bootstrap(spark, sf):
    sums = shares.cluster_sums(pairs(spark, sf).filter("category in ('a', 'b')"), "model", "cluster", "category")
    return rounded(blocks.intervals(blocks.contrast_draws(sums, "cluster", DRAWS, "contrast")), "low", "high", "sd", "pct_positive")


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, category, name, sum(half)::BIGINT AS half, count(*) AS n FROM w WHERE category IN ('a', 'b') GROUP BY ALL), {interval_sql('cluster', 'category', 'c', DRAWS, 'two', 'category')},
few2 AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS j, count(*) OVER () AS k FROM (SELECT DISTINCT name FROM c)),
drawn2 AS (SELECT b, {H.format("'two-other|' || b || '|' || j")} % k AS j FROM few2, range({DRAWS}) t(b)), times2 AS (SELECT b, name, count(*) AS times2 FROM drawn2 JOIN few2 USING (j) GROUP BY ALL),
v AS (SELECT model, t.b, 50.0 * sum(times * times2 * half) FILTER (c.category = 'a') / sum(times * times2 * n) FILTER (c.category = 'a') - 50.0 * sum(times * times2 * half) FILTER (c.category = 'b') / sum(times * times2 * n) FILTER (c.category = 'b') AS value
FROM times t JOIN c ON t.category = c.category AND t.cluster = c.cluster JOIN times2 u ON u.b = t.b AND u.name = c.name GROUP BY ALL)
SELECT model, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(stddev_samp(value), 6) AS sd, round(100.0 * count(*) FILTER (value > 0) / count(value), 6) AS pct_positive FROM v GROUP BY model""")
def b2_two_way_bootstrap(spark, sf):
    sums = shares.cluster_sums(pairs(spark, sf).filter("category in ('a', 'b')"), "model", "cluster", "category", "name")
    return rounded(blocks.intervals(blocks.contrast_draws(sums, "cluster", DRAWS, "two", "name")), "low", "high", "sd", "pct_positive")


def one_stratum(seed: str, key: str, table: str, draws: int = DRAWS) -> str:
    return f"""few AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS j, count(*) OVER () AS k FROM (SELECT DISTINCT {key} FROM {table})),
drawn AS (SELECT b, {H.format(f"'{seed}|' || b || '|' || j")} % k AS j FROM few, range({draws}) t(b)), times AS (SELECT b, {key}, count(*) AS times FROM drawn JOIN few USING (j) GROUP BY ALL)"""


@query(f"""WITH {PAIRS}, c AS (SELECT cluster, sum(abs(d)) FILTER (template = 'F') AS x1, count(*) FILTER (template = 'F') AS y1, sum(abs(d)) FILTER (template = 'O') AS x2, count(*) FILTER (template = 'O') AS y2 FROM pairs GROUP BY cluster),
{one_stratum('gap', 'cluster', 'c')}, v AS (SELECT b, sum(times * x2) / sum(times * y2) - sum(times * x1) / sum(times * y1) AS value FROM times JOIN c USING (cluster) GROUP BY b), p AS (SELECT sum(x2) / sum(y2) - sum(x1) / sum(y1) AS point FROM c)
SELECT round(point, 6) + 0.0 AS point, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(stddev_samp(value), 6) AS sd, round(100.0 * count(*) FILTER (value > 0) / count(value), 6) AS pct_positive FROM p, v GROUP BY ALL""")
def b4_b5_paired_gap_bootstrap(spark, sf):
    on = lambda t, x: F.sum(F.when(F.col("template") == t, x))
    c = pairs(spark, sf).groupBy("cluster").agg(on("F", F.abs("d")).alias("x1"), on("F", F.lit(1)).alias("y1"), on("O", F.abs("d")).alias("x2"), on("O", F.lit(1)).alias("y2"))
    return rounded(resample.paired_difference(c, ("x1", "y1"), ("x2", "y2"), "cluster", DRAWS, "gap"), "point", "low", "high", "sd", "pct_positive")


@query(f"""WITH {PAIRS}, c AS (SELECT category, cluster, sum(d) AS s, count(*) AS n FROM pairs GROUP BY ALL), {interval_sql('cluster', 'category', 'c', DRAWS, 'mean', 'category')},
v AS (SELECT t.category, b, sum(times * s) / sum(times * n) AS value FROM times t JOIN c USING (category, cluster) GROUP BY ALL), p AS (SELECT category, sum(s) / sum(n) AS point, count(*) AS clusters FROM c GROUP BY category)
SELECT category, round(point, 6) + 0.0 AS point, clusters, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(stddev_samp(value), 6) AS sd, round(100.0 * count(*) FILTER (value > 0) / count(value), 6) AS pct_positive FROM p JOIN v USING (category) GROUP BY ALL""")
def b6_b8_stratified_mean_bootstrap(spark, sf):
    c = pairs(spark, sf).groupBy("category", "cluster").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"))
    return rounded(resample.ratio_bootstrap(c, "s", "n", "cluster", DRAWS, "mean", "category"), "point", "low", "high", "sd", "pct_positive")


@query(f"""WITH {PAIRS}, t AS (SELECT model, name, sum(half)::BIGINT AS x, 2 * count(*) AS y FROM w GROUP BY ALL), v AS (SELECT *, (sum(x) OVER m - x) / (sum(y) OVER m - y) AS v FROM t WINDOW m AS (PARTITION BY model))
SELECT model, round(min(v), 6) AS least, round(max(v), 6) AS most, arg_max(name, (v, name)) AS most_without FROM v GROUP BY model""")
def b9_leave_one_name_out(spark, sf):
    s = shares.cluster_sums(pairs(spark, sf), "model", "name")
    return rounded(resample.leave_one_out(s, "name", "half", 2 * F.col("n"), "model"), "least", "most")


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, count(*) FILTER (a > b) AS w, count(*) FILTER (a <> b) AS n FROM pairs GROUP BY ALL), {interval_sql('cluster', 'model', 'c', DRAWS, 'exceed', 'model')},
v AS (SELECT t.model, b, sum(times * w) / sum(times * n) AS value FROM times t JOIN c USING (model, cluster) GROUP BY ALL), p AS (SELECT model, sum(w) / sum(n) AS point, count(*) AS clusters FROM c GROUP BY model)
SELECT model, round(point, 6) AS point, clusters, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(stddev_samp(value), 6) AS sd, round(100.0 * count(*) FILTER (value > 0) / count(value), 6) AS pct_positive FROM p JOIN v USING (model) GROUP BY ALL""")
def b12_exceedance_bootstrap(spark, sf):
    c = pairs(spark, sf).groupBy("model", "cluster").agg(F.count_if(F.col("a") > F.col("b")).alias("w"), F.count_if(F.col("a") != F.col("b")).alias("n"))
    return rounded(resample.ratio_bootstrap(c, "w", "n", "cluster", DRAWS, "exceed", "model"), "point", "low", "high", "sd", "pct_positive")


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, sum(half)::BIGINT AS half, count(*) AS n FROM w WHERE category = 'neutral' GROUP BY ALL), {interval_sql('cluster', 'model', 'c', 1000, 'neutral', 'model')},
v AS (SELECT t.model, b, 50.0 * sum(times * half) / sum(times * n) AS value FROM times t JOIN c USING (model, cluster) GROUP BY ALL), i AS (SELECT model, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM v GROUP BY model)
SELECT model, round(low, 6) AS low, round(high, 6) AS high, low <= 50 AND 50 <= high AS holds_50, CASE WHEN low > 50 THEN 'a' WHEN high < 50 THEN 'b' ELSE 'unclear' END AS direction FROM i""")
def b3_p10_p11_neutral_level(spark, sf):
    c = shares.cluster_sums(pairs(spark, sf).filter("category = 'neutral'"), "model", "cluster")
    got = blocks.intervals(blocks.level_draws(c, "cluster", 1000, "neutral"))
    return got.select("model", six(F.col("low")).alias("low"), six(F.col("high")).alias("high"), F.lit(50).between(F.col("low"), F.col("high")).alias("holds_50"), direction(F.col("low"), F.col("high")).alias("direction"))


_ = BAND
