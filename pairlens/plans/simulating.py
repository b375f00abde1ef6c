"""Pools of pairs ranked again: tie-breaks, left-out pairs, resampled names and clusters, baselines; draws in blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, resimulate, shares
from .fixtures import PAIRS, H, pairs
from .registry import query
from .shares import interval_sql, rounded

K, S, REPEATS, MANY = 10, 3, 200, 50_000


def slates(spark, sf, *more):
    """Pools of a brand, line number and status: ten name pairs, scored by whole-number means so that ties occur and every engine agrees."""
    hundredths = lambda c: F.sum(F.round(100 * F.col(c)).cast("long"))
    mean = lambda x: F.floor((2 * x + F.count(F.lit(1))) / (2 * F.count(F.lit(1))))
    p = pairs(spark, sf).filter("category <> 'drop'").groupBy(*more, "cluster", "category", "query", "template", "name").agg(
        mean(10 * hundredths("a")).alias("sa"), mean(10 * hundredths("b")).alias("sb"), mean(F.sum(F.pmod("orderkey", F.lit(97)))).alias("fa"), mean(F.sum(F.pmod("orderkey", F.lit(89)))).alias("fb"),
    )
    pool = F.concat_ws("/", *more, "cluster", F.col("query").cast("string"), "template")
    return resimulate.stacked(p.withColumn("pool", pool), ["pool", *more, "cluster", "category"], "name", {"first_m": F.col("fa"), "first_f": F.col("fb"), "second_m": F.col("sa"), "second_f": F.col("sb")})


def slate_sql(repeats: int, more: str = "") -> str:
    """CTEs up to ``each``: a row a pool and draw."""
    pool = "/' || ".join([f"{c} || '" for c in [*([more] if more else []), "cluster", "query"]]) + "/' || template"
    m = f"{more}, " if more else ""
    return f"""{PAIRS}, cell AS (SELECT {m}cluster, category, query, template, name, {pool} AS pool, count(*) AS n, 10 * sum(round(100 * a)::BIGINT) AS xa, 10 * sum(round(100 * b)::BIGINT) AS xb, sum(orderkey % 97) AS ya, sum(orderkey % 89) AS yb FROM pairs WHERE category <> 'drop' GROUP BY ALL),
doc AS (SELECT {m}pool, category, name, true AS m, floor((2 * ya + n) / (2 * n)) AS e, floor((2 * xa + n) / (2 * n)) AS r FROM cell UNION ALL SELECT {m}pool, category, name, false, floor((2 * yb + n) / (2 * n)), floor((2 * xb + n) / (2 * n)) FROM cell),
slot AS (SELECT *, 2 * (dense_rank() OVER (ORDER BY name::VARCHAR) - 1) + CASE WHEN m THEN 0 ELSE 1 END AS slot FROM doc),
t AS (SELECT *, {H.format("'slates|' || pool || '|' || rep || '|' || slot")} AS t FROM slot, range({repeats}) x(rep)),
o1 AS (SELECT *, row_number() OVER (PARTITION BY pool, rep ORDER BY e DESC, t, slot) AS r1, row_number() OVER (PARTITION BY pool, rep ORDER BY r DESC, t, slot) AS ra FROM t),
o2 AS (SELECT *, r1 <= {K} AS inn, row_number() OVER (PARTITION BY pool, rep, r1 <= {K} ORDER BY r DESC, t, slot) AS r2, rank() OVER (PARTITION BY pool, rep, r1 <= {K} ORDER BY r DESC) + (count(*) OVER (PARTITION BY pool, rep, r1 <= {K}, r) - 1) / 2 AS ar,
  rank() OVER (PARTITION BY pool, rep, r1 <= {K} ORDER BY e DESC) + (count(*) OVER (PARTITION BY pool, rep, r1 <= {K}, e) - 1) / 2 AS ae, rank() OVER (PARTITION BY pool, rep ORDER BY r DESC) + (count(*) OVER (PARTITION BY pool, rep, r) - 1) / 2 AS allr,
  rank() OVER (PARTITION BY pool, rep ORDER BY e DESC) + (count(*) OVER (PARTITION BY pool, rep, e) - 1) / 2 AS alle, least({K}, count(*) OVER (PARTITION BY pool, rep)) AS size FROM o1),
each AS (SELECT {m}pool, category, rep, count(*) AS members, count(*) FILTER (m AND inn AND r2 <= {S}) AS kept, count(*) FILTER (m AND ra <= {S}) AS alone, count(*) FILTER (m AND r1 <= {S}) AS first, count(*) FILTER (m AND inn) AS retrieved,
  avg(CASE WHEN inn THEN ar ELSE size + ae END) FILTER (NOT m) - avg(CASE WHEN inn THEN ar ELSE size + ae END) FILTER (m) AS pipe_gap, avg(allr) FILTER (NOT m) - avg(allr) FILTER (m) AS second_gap, avg(alle) FILTER (NOT m) - avg(alle) FILTER (m) AS first_gap,
  avg(CASE WHEN inn THEN (size + 1) / 2 ELSE size + ae END) FILTER (NOT m) - avg(CASE WHEN inn THEN (size + 1) / 2 ELSE size + ae END) FILTER (m) AS neutral_gap FROM o2 GROUP BY ALL),
pool_means AS (SELECT {m}pool, category, any_value(members) AS members, avg(kept) AS marked_kept, avg(alone) AS marked_alone, avg(first) AS marked_first, avg(retrieved) AS marked_retrieved, avg(pipe_gap) AS pipe_gap, avg(second_gap) AS second_gap, avg(first_gap) AS first_gap, avg(neutral_gap) AS neutral_gap FROM each GROUP BY ALL)"""


FIELDS = ["marked_kept", "marked_alone", "marked_first", "marked_retrieved", "pipe_gap", "second_gap", "first_gap", "neutral_gap"]


@query(f"WITH {slate_sql(REPEATS)} SELECT pool, category, members, {', '.join(f'round({f}, 6) + 0.0 AS {f}' for f in FIELDS)} FROM pool_means")
def r1_r2_z19_z20_slates(spark, sf):
    """Every pool's shortlists and rank gaps over 200 tie-breaks, replayed from the seed."""
    got = resimulate.simulate(slates(spark, sf).drop("cluster"), "pool", REPEATS, K, S, "slates")
    return rounded(got, *FIELDS)


@query(f"""WITH {slate_sql(20, "model")}, g AS (SELECT model, members, unnest([category, 'ALL']) AS category, {', '.join(FIELDS)} FROM pool_means),
b AS (SELECT model, category, count(*) AS pools, avg(first_gap) AS first_gap, avg(neutral_gap) AS neutral_gap, avg(pipe_gap) AS pipe_gap, avg(second_gap) AS second_gap, 100.0 * sum(marked_first) / sum(least({S}, members)) AS first_pct, 100.0 * sum(marked_retrieved) / sum(least({K}, members)) AS neutral_pct,
100.0 * sum(marked_kept) / sum(least({S}, members)) AS pipe_pct, 100.0 * sum(marked_alone) / sum(least({S}, members)) AS alone_pct FROM g GROUP BY ALL)
SELECT category, count(*) AS models, sum(pools)::BIGINT AS pools, count(*) FILTER (pipe_gap < first_gap) AS gap_below_first, count(*) FILTER (pipe_gap < neutral_gap) AS gap_below_neutral, count(*) FILTER (pipe_pct < first_pct) AS pct_below_first, count(*) FILTER (pipe_pct < neutral_pct) AS pct_below_neutral, count(*) FILTER (second_gap < 0) AS negative_gaps,
round(avg(pipe_gap - neutral_gap), 6) + 0.0 AS gap_minus_neutral, round(avg(pipe_pct), 6) AS pipe_pct, round(avg(neutral_pct), 6) AS neutral_pct FROM b GROUP BY category""")
def z23_baselines(spark, sf):
    """How many models' pipelines lie below the first stage alone and below an order-neutral re-ranker, by category."""
    each = resimulate.simulate(slates(spark, sf, "model").drop("cluster"), "pool", 20, K, S, "slates")
    b = resimulate.baselines(each, "category", "model", S, K)
    got = b.groupBy("category").agg(
        F.count(F.lit(1)).alias("models"), F.sum("pools").alias("pools"), *[F.count_if(f"{x}_below_{y}").alias(f"{x}_below_{y}") for x in ("gap", "pct") for y in ("first", "neutral")], F.count_if(F.col("second_gap") < 0).alias("negative_gaps"),
        F.avg("gap_minus_neutral").alias("gap_minus_neutral"), F.avg("pipe_pct").alias("pipe_pct"), F.avg("neutral_pct").alias("neutral_pct"),
    )
    return rounded(got, "gap_minus_neutral", "pipe_pct", "neutral_pct")


@query()
def b9_leave_one_pair_out(spark, sf):
    """Share of the shortlist without each name pair, by category; pools are ranked again with the same tie-breaks."""
    return rounded(resimulate.leave_one_pair_out(slates(spark, sf), "pool", "category", REPEATS, K, S, "slates"), "pct_marked")


@query()
def b9_joint_bootstrap(spark, sf):
    """1,000 draws of name pairs, of brands and of both, each ranked again under 200 tie-breaks."""
    pool = slates(spark, sf)
    sums = resimulate.pair_bootstrap(pool, "pool", "cluster", 1000, REPEATS, K, S, "slates")
    got = resimulate.joint_intervals(sums.join(pool.select("cluster", "category").distinct(), "cluster"), "cluster", "category", 1000, "slates")
    return rounded(got, "point", "low", "high", "sd")


# ---------------------------------------------------------------- draws in blocks


def interval_columns(v: str) -> str:
    return f"round(quantile_cont({v}, 0.025), 6) AS low, round(quantile_cont({v}, 0.975), 6) AS high, round(stddev_samp({v}), 6) AS sd, round(100.0 * count(*) FILTER ({v} > 0) / count({v}), 6) AS pct_positive"


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, category, sum(half)::BIGINT AS half, count(*) AS n FROM w WHERE category IN ('a', 'b') GROUP BY ALL), {interval_sql('cluster', 'category', 'c', MANY, 'contrast', 'category')},
v AS (SELECT model, b, 50.0 * sum(times * half) FILTER (c.category = 'a') / sum(times * n) FILTER (c.category = 'a') - 50.0 * sum(times * half) FILTER (c.category = 'b') / sum(times * n) FILTER (c.category = 'b') AS value
FROM times t JOIN c ON t.category = c.category AND t.cluster = c.cluster GROUP BY ALL) SELECT model, {interval_columns('value')} FROM v GROUP BY model""")
def b2_contrast_50000(spark, sf):
    """The contrasts' intervals at 50,000 draws."""
    sums = shares.cluster_sums(pairs(spark, sf).filter("category in ('a', 'b')"), "model", "cluster", "category")
    return rounded(blocks.intervals(blocks.contrast_draws(sums, "cluster", MANY, "contrast")), "low", "high", "sd", "pct_positive")


@query()
def b3_neutral_level_1000000(spark, sf):
    """The evenly split clusters' level at 1,000,000 draws."""
    c = shares.cluster_sums(pairs(spark, sf).filter("category = 'neutral'"), "model", "cluster")
    return rounded(blocks.intervals(blocks.level_draws(c, "cluster", 1_000_000, "neutral")), "low", "high", "sd", "pct_positive")


@query()
def h2_label_permutation_1000000(spark, sf):
    """Label permutations at 1,000,000 draws."""
    sums = shares.cluster_sums(pairs(spark, sf), "model", "cluster", "category")
    return rounded(blocks.label_permutation(sums, "cluster", 1_000_000, "lab"), "p_one_sided", "p_two_sided")
