"""Ranks, shortlists, pools and the tests on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_int, six
from ..operators import blocks, prefix, ranking, resample, shares, tests
from .fixtures import H, PAIRS, POOLS, pairs, pools
from .registry import query
from .shares import DRAWS, rounded

W = Window.partitionBy


@query(f"""WITH {POOLS} SELECT pool, member, rank() OVER s + (count(*) OVER (PARTITION BY pool, score) - 1) / 2.0 AS avg_rank, row_number() OVER (PARTITION BY pool ORDER BY score DESC, tb)::INTEGER AS rank
FROM pools WINDOW s AS (PARTITION BY pool ORDER BY score DESC)""")
def w1_w2_ranks(spark, sf):
    p = prefix.ranks(pools(spark, sf).select("pool", "member", "score", "tb"), ["pool"], "score", ["tb", "member"])
    return p.select("pool", "member", "avg_rank", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {POOLS}, r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC, tb) AS rank, count(*) OVER (PARTITION BY pool) AS members, row_number() OVER (PARTITION BY pool ORDER BY first_score DESC, tb) AS first FROM pools)
SELECT pool, rank, members, rank <= 3 AS top_3 FROM r WHERE first = 1""")
def w14_target_rank(spark, sf):
    """Where the first scores' best member of each pool lies by the second scores."""
    p = pools(spark, sf)
    best = p.groupBy("pool").agg(F.min_by(F.struct("score", "tb"), F.struct(-F.col("first_score"), F.col("tb"))).alias("t")).select("pool", "t.score", "t.tb")
    return ranking.target_ranks(p, best).withColumn("top_3", F.col("rank") <= 3)


@query(f"""WITH {POOLS}, r AS (SELECT *, rank() OVER (PARTITION BY pool ORDER BY score DESC) + (count(*) OVER (PARTITION BY pool, score) - 1) / 2.0 AS ar, row_number() OVER (PARTITION BY pool ORDER BY score DESC, tb) AS rn FROM pools), k(k) AS (VALUES (1), (3), (5), (10))
SELECT pool, k, coalesce(max(score) FILTER (rn = k) = max(score) FILTER (rn = k + 1), false) AS tie, count(*) FILTER (ar <= k) AS by_average_rank FROM r, k GROUP BY ALL""")
def w5_a14_r11_cutoff_ties(spark, sf):
    return ranking.cutoff_ties(pools(spark, sf), [1, 3, 5, 10])


@query(f"""WITH {POOLS}, r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY first_score DESC, tb) AS r1, row_number() OVER (PARTITION BY pool ORDER BY score DESC, tb) AS alone FROM pools), ks(K) AS (VALUES (5), (10), (15)), ss(S) AS (VALUES (1), (3), (5)),
i AS (SELECT *, row_number() OVER (PARTITION BY pool, K ORDER BY score DESC, tb) AS r2 FROM r, ks WHERE r1 <= K),
b AS (SELECT pool, K, S, count(*) FILTER (r2 <= S) AS kept, count(*) FILTER (r2 <= S AND marked) AS marked FROM i, ss GROUP BY ALL), a AS (SELECT pool, S, count(*) FILTER (alone <= S AND marked) AS marked_alone FROM r, ss GROUP BY ALL)
SELECT pool, S, K, kept, marked, marked_alone FROM b JOIN a USING (pool, S)""")
def t1_t2_r4_two_stage_grid(spark, sf):
    return ranking.two_stage(pools(spark, sf), [5, 10, 15], [1, 3, 5])


@query(f"""WITH {POOLS}, r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY first_score DESC, tb) AS r1 FROM pools), p AS (SELECT *, r1 <= 10 AS retrieved FROM r)
SELECT pool, member, (CASE WHEN retrieved THEN row_number() OVER (PARTITION BY pool, retrieved ORDER BY score DESC, tb) ELSE r1 END)::INTEGER AS place FROM p""")
def w7_two_block_ranks(spark, sf):
    return ranking.two_block_rank(pools(spark, sf), 10).select("pool", "member", F.col("place").cast("int").alias("place"))


@query(f"""WITH {POOLS}, d AS (SELECT *, {H.format("'sim|' || b || '|' || member")} AS t FROM pools, range(200) x(b)), r AS (SELECT *, row_number() OVER (PARTITION BY pool, b ORDER BY first_score DESC, t, member) AS r1 FROM d),
i AS (SELECT *, r1 <= 10 AS inn FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY pool, b, inn ORDER BY score DESC, t, member) AS r2 FROM i),
e AS (SELECT pool, b, count(*) FILTER (inn AND r2 <= 3 AND marked) AS marked, count(*) FILTER (inn AND marked) AS rm, avg(r1) FILTER (NOT marked) - avg(r1) FILTER (marked) AS gap FROM k GROUP BY ALL)
SELECT pool, round(avg(marked), 6) AS marked, round(avg(rm), 6) AS retrieved_marked, round(avg(gap), 6) + 0.0 AS gap FROM e GROUP BY pool""")
def r1_r2_r3_simulation(spark, sf):
    return rounded(ranking.simulate(pools(spark, sf), 200, 10, 3, "sim"), "marked", "retrieved_marked", "gap")


OTHER = f"({H.format("'alt|' || member")} % 21) / 20.0"


@query(f"""WITH {POOLS}, p AS (SELECT *, {OTHER} AS other, row_number() OVER (PARTITION BY pool ORDER BY score DESC, tb) AS rank FROM pools),
r AS (SELECT f.pool, f.member, f.rank, 1 + (SELECT count(*) FROM p o WHERE o.pool = f.pool AND o.member <> f.member AND (o.score > f.other OR (o.score = f.other AND o.tb < f.tb))) AS other_rank FROM p f), k(k) AS (VALUES (1), (3), (5))
SELECT k, count(*) AS n, count(*) FILTER ((rank <= k) <> (other_rank <= k)) AS flips, count(*) FILTER (rank <= k AND other_rank > k) AS only_original, count(*) FILTER (rank > k AND other_rank <= k) AS only_other,
count(*) FILTER (rank <= k AND other_rank > k) - count(*) FILTER (rank > k AND other_rank <= k) AS net, count(*) FILTER (rank <= k AND other_rank <= k) AS both_in, count(*) FILTER (rank > k AND other_rank > k) AS both_out FROM r, k GROUP BY k""")
def w4_r7_a13_p9_flips(spark, sf):
    other = F.pmod(hash_int(F.lit("alt"), F.col("member")), F.lit(21)) / 20.0
    return ranking.shortlist_flips(pools(spark, sf), other, [1, 3, 5])


RANKED = f"""{POOLS}, r AS (SELECT *, rank() OVER (PARTITION BY pool ORDER BY score DESC) + (count(*) OVER (PARTITION BY pool, score) - 1) / 2.0 AS ar FROM pools), i AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY ar, member) AS i, min(ar) OVER (PARTITION BY pool) AS best FROM r),
m AS (SELECT pool, count(*) FILTER (marked AND ar = best) / count(*) FILTER (ar = best) AS top1, coalesce(max(CASE WHEN marked THEN 1 / ar END), 0) AS mrr, sum(CASE WHEN marked AND i <= 10 THEN 1 / log2(i + 1) ELSE 0 END) AS dcg, count(*) FILTER (marked) AS n_rel FROM i GROUP BY pool),
metrics AS (SELECT pool, top1, mrr, CASE WHEN n_rel = 0 THEN 0 ELSE dcg / (SELECT sum(1 / log2(x + 1)) FROM range(1, 11) t(x) WHERE x <= n_rel) END AS ndcg FROM m)"""


@query(f"WITH {RANKED} SELECT pool, round(top1, 6) AS top1, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM metrics")
def r8_rank_metrics(spark, sf):
    return rounded(ranking.rank_metrics(pools(spark, sf)), "top1", "mrr", "ndcg")


@query(f"""WITH {RANKED} SELECT round(avg(top1), 6) AS top1, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) FILTER (top1 > 0.5 + 1e-12) AS n_up, count(*) FILTER (top1 < 0.5 - 1e-12) AS n_down FROM metrics""")
def r9_utility_summary(spark, sf):
    m = ranking.rank_metrics(pools(spark, sf))
    return m.agg(six(F.avg("top1")).alias("top1"), six(F.avg("mrr")).alias("mrr"), six(F.avg("ndcg")).alias("ndcg"), F.count_if(F.col("top1") > 0.5 + 1e-12).alias("n_up"), F.count_if(F.col("top1") < 0.5 - 1e-12).alias("n_down"))


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, pct, 50.0 * sum(half) / count(*) AS s FROM w GROUP BY ALL), r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY pct) + (count(*) OVER (PARTITION BY model, pct) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0 AS ry FROM c)
SELECT model, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY model""")
def c1_spearman(spark, sf):
    return rounded(tests.spearman(cluster_points(spark, sf), "pct", "s", "model"), "rho")


def cluster_points(spark, sf):
    return shares.cluster_sums(pairs(spark, sf), "model", "cluster", "pct").withColumn("s", shares.share(F.col("half"), F.col("n")))


POINTS = f"{PAIRS}, c AS (SELECT model, cluster, pct, 50.0 * sum(half) / count(*) AS s, count(*) AS n, sum(half)::BIGINT AS half FROM w GROUP BY ALL)"


@query(f"""WITH {POINTS} SELECT l.model, round(sum(sign(l.pct - r.pct) * sign(l.s - r.s)) / sqrt(sum(abs(sign(l.pct - r.pct))) * sum(abs(sign(l.s - r.s)))), 6) AS tau FROM c l JOIN c r ON l.model = r.model AND l.cluster < r.cluster GROUP BY l.model""")
def c2_kendall(spark, sf):
    return rounded(tests.kendall(cluster_points(spark, sf), "pct", "s", "cluster", "model"), "tau")


@query(f"WITH {POINTS} SELECT model, round(regr_slope(s, pct), 6) AS slope, round(regr_intercept(s, pct), 6) AS intercept, round(corr(pct, s), 6) AS r, round(regr_r2(s, pct), 6) AS r2 FROM c GROUP BY model")
def c3_c4_regression(spark, sf):
    return rounded(tests.regression(cluster_points(spark, sf), "pct", "s", "model"), "slope", "intercept", "r", "r2")


@query(f"""WITH {POINTS}, r AS (SELECT model, cluster, rank() OVER (PARTITION BY model ORDER BY pct) + (count(*) OVER (PARTITION BY model, pct) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0 AS ry, row_number() OVER (PARTITION BY model ORDER BY cluster) AS at FROM c),
o AS (SELECT model, b, cluster, row_number() OVER (PARTITION BY model, b ORDER BY {H.format("'perm|' || b || '|' || cluster")}, cluster) AS rn FROM r, range({DRAWS}) t(b)),
s AS (SELECT o.model, b, corr(x.rx, y.ry) AS star FROM o JOIN r x ON x.model = o.model AND x.cluster = o.cluster JOIN r y ON y.model = o.model AND y.at = o.rn GROUP BY ALL), rho AS (SELECT model, corr(rx, ry) AS rho FROM r GROUP BY model)
SELECT model, round(rho, 6) AS rho, round((1 + count(*) FILTER (abs(star) >= abs(rho) - 1e-12)) / ({DRAWS} + 1.0), 6) AS p FROM s JOIN rho USING (model) GROUP BY ALL""")
def h3_spearman_permutation(spark, sf):
    return rounded(blocks.spearman_permutation(cluster_points(spark, sf), "pct", "s", "cluster", DRAWS, "perm"), "rho", "p")


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, category, sum(half)::BIGINT AS half FROM w WHERE category IN ('a', 'b') GROUP BY ALL), z AS (SELECT count(*) AS k, count(*) FILTER (category = 'a') AS ka FROM (SELECT DISTINCT cluster, category FROM c)),
o AS (SELECT b, cluster, row_number() OVER (PARTITION BY b ORDER BY {H.format("'lab|' || b || '|' || cluster")}, cluster) AS rn FROM (SELECT DISTINCT cluster FROM c), range({DRAWS}) t(b)),
t AS (SELECT model, sum(half) AS t, sum(half) FILTER (category = 'a') AS sa FROM c GROUP BY model), s AS (SELECT model, b, sum(half) AS s FROM o JOIN c USING (cluster), z WHERE rn <= ka GROUP BY ALL),
v AS (SELECT model, k * s - ka * t AS v, k * sa - ka * t AS seen FROM s JOIN t USING (model), z)
SELECT model, round((1 + count(*) FILTER (v >= seen)) / ({DRAWS} + 1.0), 6) AS p_one_sided, round((1 + count(*) FILTER (abs(v) >= abs(seen))) / ({DRAWS} + 1.0), 6) AS p_two_sided FROM v GROUP BY model""")
def h2_t5_label_permutation(spark, sf):
    sums = shares.cluster_sums(pairs(spark, sf), "model", "cluster", "category")
    return rounded(blocks.label_permutation(sums, "cluster", DRAWS, "lab"), "p_one_sided", "p_two_sided")


@query(f"""WITH p AS (SELECT p_brand AS key, (1 + {H.format('p_brand')} % 1000) / 1000.0 * 0.05 AS p FROM (SELECT DISTINCT p_brand FROM part)), r AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, key) + 1) * p) AS raw, count(*) OVER () AS m FROM p)
SELECT key, round(p, 6) AS p, round(max(raw) OVER (ORDER BY p, key), 6) AS p_holm, round(least(1, m * p), 6) AS p_bonferroni FROM r""")
def h1_w11_holm(spark, sf):
    p = pairs(spark, sf).select(F.col("cluster").alias("key")).distinct().withColumn("p", (1 + F.pmod(hash_int(F.col("key")), F.lit(1000))) / 1000.0 * 0.05)
    return rounded(tests.bonferroni(tests.holm(p, "p", "key"), "p"), "p", "p_holm", "p_bonferroni")


#: The exact p from logarithms of the counts of outcomes, the largest taken out before they are added.
LOGS = "list_transform(range(0, least(b, c) + 1), lambda i: lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0::DOUBLE))"
FACT = "CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2.0 * exp(list_max(l)) * list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) END"


@query(f"""WITH {POOLS}, g AS (SELECT pool, (count(*) FILTER (marked AND score > 0.9))::INTEGER AS b, (count(*) FILTER (NOT marked AND score > 0.9))::INTEGER AS c FROM pools GROUP BY pool) SELECT pool, b::BIGINT AS b, c::BIGINT AS c, round({FACT}, 6) AS p FROM (SELECT *, {LOGS} AS l FROM g)""")
def h6_h7_mcnemar(spark, sf):
    p = pools(spark, sf).groupBy("pool").agg(F.count_if(F.col("marked") & (F.col("score") > 0.9)).alias("b"), F.count_if(~F.col("marked") & (F.col("score") > 0.9)).alias("c"))
    return p.select("pool", "b", "c", six(tests.mcnemar(F.col("b"), F.col("c"))).alias("p"))


@query(f"WITH {PAIRS}, g AS (SELECT model, count(*) FILTER (a > b) AS b, count(*) FILTER (a < b) AS c FROM pairs GROUP BY model), l AS (SELECT *, {LOGS} AS l FROM g) SELECT model, b, c, round({FACT}, 6) AS p FROM l")
def h6_mcnemar_any_size(spark, sf):
    p = pairs(spark, sf).groupBy("model").agg(F.count_if(F.expr("a > b")).alias("b"), F.count_if(F.expr("a < b")).alias("c"))
    return p.select("model", "b", "c", six(tests.mcnemar(F.col("b"), F.col("c"))).alias("p"))


TAIL = "(0.254829592 + e * (-0.284496736 + e * (1.421413741 + e * (-1.453152027 + e * 1.061405429)))) * e"  # of the normal's two-sided p


@query(f"""WITH {PAIRS}, nz AS (SELECT model, cluster, d, rank() OVER (PARTITION BY model, cluster ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, cluster, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY model, cluster, abs(d)) AS t FROM pairs WHERE d <> 0),
g AS (SELECT model, cluster, count(*) AS n, sum(t * t - 1) AS ties, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS wm FROM nz GROUP BY ALL),
q AS (SELECT *, (wp - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM g), u AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0::DOUBLE)) AS e FROM q)
SELECT model, cluster, n, round(wp, 6) AS w_plus, round(wm, 6) AS w_minus, round(z, 6) AS z, round({TAIL} * exp(-z * z / 2), 6) AS p FROM u""")
def h8_wilcoxon(spark, sf):
    return rounded(tests.wilcoxon(pairs(spark, sf), "d", "model", "cluster"), "w_plus", "w_minus", "z", "p")


@query(f"""WITH {PAIRS}, g AS (SELECT model, count(d) AS n, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, count(*) FILTER (a > b) AS k FROM pairs GROUP BY model), q AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM g)
SELECT model, n, round(t, 6) AS t, round((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS high FROM q""")
def h8_t_test_and_wilson(spark, sf):
    p = pairs(spark, sf)
    t = tests.one_sample_t(p, "d", "model")
    k = p.groupBy("model").agg(F.count_if(F.expr("a > b")).alias("k"))
    return t.join(k, "model").withColumn("w", tests.wilson(F.col("k"), F.col("n"))).select("model", "n", six(F.col("t")).alias("t"), six(F.col("w.low")).alias("low"), six(F.col("w.high")).alias("high"))


@query(f"""WITH {PAIRS}, c AS (SELECT category, cluster, avg(d) AS v FROM pairs GROUP BY ALL), r AS (SELECT category, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY v) AS t FROM c), g AS (SELECT category, sum(r) AS s, count(*) AS n, sum(t * t - 1) AS ties FROM r GROUP BY category),
q AS (SELECT count(*) AS groups, sum(n)::BIGINT AS n, (12.0 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / nullif(1 - sum(ties) / nullif(sum(n)::DOUBLE ** 3 - sum(n), 0), 0) AS h FROM g),
u AS (SELECT *, groups - 1 AS k, sqrt(h) AS z, 1 / (1 + 0.3275911 * sqrt(h) / sqrt(2.0::DOUBLE)) AS e FROM q)
SELECT groups, n, round(h, 6) AS h, round(CASE WHEN k % 2 = 0 THEN exp(-h / 2) * coalesce(list_sum(list_transform(range(k // 2), lambda i: (h / 2) ** i / gamma(i + 1))), 0)
  ELSE {TAIL} * exp(-h / 2) + exp(-h / 2) * coalesce(list_sum(list_transform(range(k // 2), lambda i: (h / 2) ** (i + 0.5) / gamma(i + 1.5))), 0) END, 6) AS p FROM u""")
def h8_kruskal(spark, sf):
    c = pairs(spark, sf).groupBy("category", "cluster").agg(F.avg("d").alias("v"))
    return rounded(tests.kruskal(c, "v", "category"), "h", "p")


@query(f"""WITH {PAIRS}, g AS (SELECT model, category, count(*) AS n, avg((a > 0.05)::INTEGER) AS px, avg((b > 0.04)::INTEGER) AS py, count(*) FILTER ((a > 0.05) = (b > 0.04)) AS same FROM pairs GROUP BY ALL)
SELECT round(sum(same) / sum(n), 6) AS agreement, round(sum(n * (px * py + (1 - px) * (1 - py))) / sum(n), 6) AS baseline FROM g""")
def c5_independence_baseline(spark, sf):
    p = pairs(spark, sf).withColumn("x", F.col("a") > 0.05).withColumn("y", F.col("b") > 0.04)
    return rounded(tests.independence_baseline(p, "x", "y", "model", "category"), "agreement", "baseline")


@query(f"""WITH {POINTS}, few AS (SELECT *, row_number() OVER (ORDER BY model) - 1 AS j, count(*) OVER () AS k FROM (SELECT DISTINCT query AS model FROM pairs)),
m AS (SELECT query AS model, avg(d) AS x, 50.0 * sum(half) / count(*) AS y FROM w GROUP BY query),
drawn AS (SELECT b, j AS slot, {H.format("'models|' || b || '|' || j")} % k AS j FROM few, range({DRAWS}) t(b)), s AS (SELECT b, x, y FROM drawn JOIN few USING (j) JOIN m USING (model)),
r AS (SELECT b, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY b ORDER BY y) + (count(*) OVER (PARTITION BY b, y) - 1) / 2.0 AS ry FROM s),
v AS (SELECT b, corr(rx, ry) AS value FROM r GROUP BY b HAVING count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1)
SELECT round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(*) AS draws FROM v""")
def b11_model_resampled_spearman(spark, sf):
    p = pairs(spark, sf)
    m = shares.cluster_sums(p, "query").select(F.col("query").alias("model"), shares.share(F.col("half"), F.col("n")).alias("y")).join(p.groupBy(F.col("query").alias("model")).agg(F.avg("d").alias("x")), "model")
    drawn = resample.weights(m, "model", DRAWS, "models").join(m, "model").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    r = drawn.withColumn("rx", tests.average_rank("x", "b")).withColumn("ry", tests.average_rank("y", "b"))
    v = r.groupBy("b").agg(F.corr("rx", "ry").alias("value"), F.count_distinct("rx").alias("nx"), F.count_distinct("ry").alias("ny")).filter("nx > 1 and ny > 1")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return v.agg(six(q[0]).alias("low"), six(q[1]).alias("high"), F.count(F.lit(1)).alias("draws"))


@query(f"""WITH {PAIRS}, n AS (SELECT model, name, sum(half)::BIGINT AS half, count(*) AS n FROM w GROUP BY ALL),
o AS (SELECT model, b, name, row_number() OVER (PARTITION BY model, b ORDER BY {H.format("'placebo|' || b || '|' || name")}, name) AS rn FROM n, range({DRAWS}) t(b)),
c AS (SELECT o.model, b, 50.0 * sum(half) FILTER (rn <= 5) / sum(n) FILTER (rn <= 5) - 50.0 * sum(half) FILTER (rn > 5) / sum(n) FILTER (rn > 5) AS v FROM o JOIN n USING (model, name) GROUP BY ALL),
s AS (SELECT model, 50.0 * sum(half) FILTER (name < 5) / sum(n) FILTER (name < 5) - 50.0 * sum(half) FILTER (name >= 5) / sum(n) FILTER (name >= 5) AS seen FROM n GROUP BY model)
SELECT model, round(seen, 6) + 0.0 AS seen, round(max(abs(v)), 6) AS most, round((1 + count(*) FILTER (abs(v) >= abs(seen) - 1e-12)) / ({DRAWS} + 1.0), 6) AS p FROM c JOIN s USING (model) GROUP BY ALL""")
def h4_h5_placebo(spark, sf):
    n = shares.cluster_sums(pairs(spark, sf), "model", "name")
    part = lambda cond: 50.0 * F.sum(F.when(cond, F.col("half"))) / F.sum(F.when(cond, F.col("n")))
    c = resample.permuted(n, "name", DRAWS, "placebo", "model").join(n, ["model", "name"]).groupBy("model", "b").agg((part(F.col("rn") <= 5) - part(F.col("rn") > 5)).alias("v"))
    s = n.groupBy("model").agg((part(F.col("name") < 5) - part(F.col("name") >= 5)).alias("seen"))
    got = c.join(s, "model").groupBy("model", "seen").agg(F.max(F.abs("v")).alias("most"), ((1 + F.count_if(F.abs("v") >= F.abs("seen") - 1e-12)) / (1.0 + DRAWS)).alias("p"))
    return rounded(got, "seen", "most", "p")
