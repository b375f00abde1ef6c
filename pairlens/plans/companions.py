"""Summaries over models: replay, utility, length by arm, directions, precision, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import hash_int
from ..operators import blocks, channels, companions, ranking, resample, resimulate, shares
from ..sinks.shared import kept
from .fixtures import PAIRS, POOLS, H, pairs, pools, table
from .ranking import POINTS, RANKED, cluster_points
from .registry import query
from .shares import DRAWS, interval_sql, rounded
from .simulating import K, S, slate_sql

REPLAYS = slate_sql(20, "model").split("\nt AS (SELECT *")[0].replace("slot AS (", "slot0 AS (", 1).rstrip().rstrip(",")
LIVE = H.format("'live|' || pool || '|' || slot")


@query(f"""WITH {REPLAYS}, slot AS (SELECT *, CASE WHEN {LIVE} % 4 = 0 THEN r + {LIVE} % 7 - 3 ELSE r END AS l FROM slot0), t AS (SELECT *, {H.format("'slates|' || pool || '|' || rep || '|' || slot")} AS t FROM slot, range(20) x(rep)),
o1 AS (SELECT *, row_number() OVER (PARTITION BY pool, rep ORDER BY e DESC, t, slot) AS r1 FROM t), o2 AS (SELECT *, row_number() OVER (PARTITION BY pool, rep ORDER BY r DESC, t, slot) AS rb, row_number() OVER (PARTITION BY pool, rep ORDER BY l DESC, t, slot) AS rl FROM o1 WHERE r1 <= {K}),
e AS (SELECT model, pool, split_part(pool, '/', 2) AS cluster, rep, count(*) FILTER (m AND rb <= {S}) AS kb, count(*) FILTER (m AND rl <= {S}) AS kl, bool_and((rb <= {S}) = (rl <= {S})) AS same FROM o2 GROUP BY ALL), sizes AS (SELECT pool, least({S}, count(*)) AS room FROM slot GROUP BY pool),
p AS (SELECT model, pool, cluster, any_value(room) AS room, avg(kb) AS kb, avg(kl) AS kl, avg(same::INTEGER) AS same FROM e JOIN sizes USING (pool) GROUP BY ALL), c AS (SELECT model, cluster, sum(100.0 * (kl - kb) / room) AS d, count(*) AS n FROM p GROUP BY ALL), {interval_sql('cluster', 'model', 'c', DRAWS, 'replay', 'model')},
v AS (SELECT t.model, b, sum(times * d) / sum(times * n) AS value FROM times t JOIN c USING (model, cluster) GROUP BY ALL), i AS (SELECT model, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM v GROUP BY model),
l AS (SELECT model, count(*) AS pools, 100.0 * sum(kb) / sum(room) AS replay_pct, 100.0 * sum(kl) / sum(room) AS live_pct, 100.0 * avg(same) AS identical_pct FROM p GROUP BY model), d AS (SELECT model, sum(d) / sum(n) AS diff FROM c GROUP BY model)
SELECT model, pools, round(replay_pct, 6) AS replay_pct, round(live_pct, 6) AS live_pct, round(identical_pct, 6) AS identical_pct, round(diff, 6) + 0.0 AS diff, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, low <= 0 AND high >= 0 AS supported FROM l JOIN d USING (model) JOIN i USING (model)""")
def z24_z25_replay(spark, sf):
    """Banked scores replayed against live ones of the retrieved documents, under the same tie-breaks."""
    from .simulating import slates

    p = slates(spark, sf, "model")
    names = sorted(r[0] for r in p.select(F.explode("slots.pair")).distinct().collect())
    place = lambda x: F.array_position(F.array(*map(F.lit, names)), x["pair"]) - 1

    def live(x, side):
        h = hash_int(F.lit("live"), F.col("pool"), 2 * place(x) + (0 if side == "m" else 1))
        return F.when(h % 4 == 0, x[f"second_{side}"] + h % 7 - 3).otherwise(x[f"second_{side}"])

    p = p.withColumn("slots", F.transform("slots", lambda x: x.withField("live_m", live(x, "m")).withField("live_f", live(x, "f"))))
    got = companions.replay_summary(kept(resimulate.replayed(p, "pool", 20, K, S, "slates"), "replays"), "model", "cluster", S, DRAWS, "replay")
    return rounded(got, "replay_pct", "live_pct", "identical_pct", "diff", "low", "high")


def metrics_sql(score: str, out: str) -> str:
    return RANKED.partition("r AS (")[2].replace("rank() OVER (PARTITION BY pool ORDER BY score DESC)", f"rank() OVER (PARTITION BY pool ORDER BY {score} DESC)").replace("count(*) OVER (PARTITION BY pool, score)", f"count(*) OVER (PARTITION BY pool, {score})").replace("FROM pools), i AS", f"FROM pools), i_{out} AS").replace("FROM r),\nm AS", f"FROM r_{out}),\nm_{out} AS").replace("FROM i GROUP", f"FROM i_{out} GROUP").replace("metrics AS", f"metrics_{out} AS").replace("FROM m)", f"FROM m_{out})")


METRICS = f"{POOLS}, r_before AS ({metrics_sql('first_score', 'before')}, r_after AS ({metrics_sql('score', 'after')}"


@query(f"""WITH {METRICS}, s AS (SELECT 'top1' AS metric, pool AS query, b.top1 AS x, a.top1 AS y FROM metrics_before b JOIN metrics_after a USING (pool) UNION ALL SELECT 'mrr', pool, b.mrr, a.mrr FROM metrics_before b JOIN metrics_after a USING (pool) UNION ALL SELECT 'ndcg', pool, b.ndcg, a.ndcg FROM metrics_before b JOIN metrics_after a USING (pool)),
{interval_sql('query', 'metric', 's', DRAWS, 'utility', 'metric')}, v AS (SELECT t.metric, b, sum(times * (y - x)) / sum(times) AS value FROM times t JOIN s USING (metric, query) GROUP BY ALL), i AS (SELECT metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM v GROUP BY metric)
SELECT metric, round(avg(x), 6) AS before, round(avg(y), 6) AS after, round(avg(y - x), 6) + 0.0 AS change, round(any_value(low), 6) + 0.0 AS low, round(any_value(high), 6) + 0.0 AS high, any_value(low <= 0 AND high >= 0) AS holds_zero FROM s JOIN i USING (metric) GROUP BY metric""")
def z39_utility(spark, sf):
    """Top-1, reciprocal rank and nDCG of two conditions' scores, and their changes resampled by query."""
    p = pools(spark, sf)
    of = lambda score, out: ranking.rank_metrics(p, score=score).select("pool", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(out)) for m in ("top1", "mrr", "ndcg")])).alias("m")).select("pool", "m.*")
    both = of("first_score", "before").join(of("score", "after"), ["pool", "metric"]).withColumnRenamed("pool", "query")
    got = resample.mean_change(both, "query", "before", "after", DRAWS, "utility", "metric").drop("up", "down")
    return rounded(got.withColumn("holds_zero", (F.col("low") <= 0) & (F.col("high") >= 0)), "before", "after", "change", "low", "high")


BANDS = "CASE WHEN quantity <= 15 THEN 'short' WHEN quantity <= 35 THEN 'middle' ELSE 'full' END"


@query(f"""WITH {PAIRS}, c AS (SELECT model || '/' || {BANDS} AS model, template AS arm, category, cluster, sum(half)::BIGINT AS half, count(*) AS n FROM w WHERE category IN ('a', 'b') GROUP BY ALL), {interval_sql('cluster', 'category', 'c', DRAWS, 'length', 'category')},
v AS (SELECT model, arm, b, 50.0 * sum(times * half) FILTER (t.category = 'a') / sum(times * n) FILTER (t.category = 'a') - 50.0 * sum(times * half) FILTER (t.category = 'b') / sum(times * n) FILTER (t.category = 'b') AS value FROM times t JOIN c ON c.category = t.category AND c.cluster = t.cluster GROUP BY ALL),
p AS (SELECT model, arm, 50.0 * sum(half) FILTER (category = 'a') / sum(n) FILTER (category = 'a') - 50.0 * sum(half) FILTER (category = 'b') / sum(n) FILTER (category = 'b') AS point FROM c GROUP BY ALL),
g AS (SELECT x.model, any_value(p.point - q.point) AS diff, quantile_cont(x.value - y.value, 0.025) AS low, quantile_cont(x.value - y.value, 0.975) AS high FROM v x JOIN v y ON x.model = y.model AND x.b = y.b AND x.arm = 'O' AND y.arm = 'F' JOIN p ON p.model = x.model AND p.arm = 'O' JOIN p q ON q.model = x.model AND q.arm = 'F' GROUP BY x.model)
SELECT split_part(model, '/', 2) AS length, count(*) AS models, round(min(diff), 6) + 0.0 AS least, round(max(diff), 6) + 0.0 AS most, round(max(abs(diff)), 6) AS largest, count(*) FILTER (low <= 0 AND high >= 0) AS about_zero, count(*) FILTER (high < 0) AS below_zero, count(*) FILTER (low > 0) AS above_zero FROM g GROUP BY 1""")
def z5_z7_length_by_arm(spark, sf):
    """One arm's contrast minus the other's at each length, over models, with paired intervals."""
    p = pairs(spark, sf).filter("category in ('a', 'b')").withColumn("model", F.concat_ws("/", "model", F.expr(BANDS)))
    sums = shares.cluster_sums(p, "model", "template", "category", "cluster").withColumnRenamed("template", "arm")
    _, changes = channels.paired_contrasts(sums, "arm", "cluster", DRAWS, "length")
    one = changes.filter("arm = 'O' and against = 'F'").withColumn("length", F.split("model", "/")[1])
    return rounded(companions.changes_summary(one, "change", "low", "high", "length"), "least", "most", "largest")


@query(f"""WITH {POINTS}, r AS (SELECT model, cluster, s, rank() OVER (PARTITION BY model ORDER BY pct) + (count(*) OVER (PARTITION BY model, pct) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2.0 AS ry, row_number() OVER (PARTITION BY model ORDER BY cluster) AS at FROM c),
o AS (SELECT model, b, cluster, row_number() OVER (PARTITION BY model, b ORDER BY {H.format("'dir|' || b || '|' || cluster")}, cluster) AS rn FROM r, range({DRAWS}) t(b)), s AS (SELECT o.model, b, corr(x.rx, y.ry) AS star FROM o JOIN r x ON x.model = o.model AND x.cluster = o.cluster JOIN r y ON y.model = o.model AND y.at = o.rn GROUP BY ALL), rho AS (SELECT model, corr(rx, ry) AS rho FROM r GROUP BY model),
p AS (SELECT model, rho, (1 + count(*) FILTER (abs(star) >= abs(rho) - 1e-12)) / ({DRAWS} + 1.0) AS p FROM s JOIN rho USING (model) GROUP BY ALL), d AS (SELECT *, CASE WHEN p < 0.5 AND rho < 0 THEN 'a' WHEN p < 0.5 AND rho > 0 THEN 'b' ELSE 'unclear' END AS direction FROM p)
SELECT direction, count(*) AS models, round(min(rho), 6) AS least, arg_min(model, (rho, model)) AS least_model, round(max(rho), 6) AS most, arg_min(model, (-rho, model)) AS most_model FROM d GROUP BY direction""")
def z6_directions(spark, sf):
    """Which way each model's shares run with the percentage, by permutation of clusters, and the span of each direction."""
    got = blocks.spearman_permutation(cluster_points(spark, sf), "pct", "s", "cluster", DRAWS, "dir")
    d = got.withColumn("direction", companions.direction(F.col("rho"), F.col("p"), 0.5))
    return rounded(companions.span(d, "model", "rho", "direction"), "least", "most")


BF = "CASE WHEN {0}::FLOAT::DOUBLE = 0 THEN 0.0 ELSE round_even({0}::FLOAT::DOUBLE / pow(2.0, floor(log2(abs({0}::FLOAT::DOUBLE))) - 7), 0) * pow(2.0, floor(log2(abs({0}::FLOAT::DOUBLE))) - 7) END"
WIN = "CASE WHEN {0} > {1} THEN 1.0 WHEN {0} = {1} THEN 0.5 ELSE 0.0 END"


@query(f"""WITH {PAIRS}, r AS (SELECT model, x, y, {BF.format('x')} AS u, {BF.format('y')} AS v FROM (SELECT model, 1 + a::DOUBLE AS x, 1 + b::DOUBLE AS y FROM pairs))
SELECT model, count(*) AS n, count(*) FILTER (u = x AND v = y) AS n_coarse, round(100.0 * avg({WIN.format('x', 'y')}) FILTER (NOT (u = x AND v = y)), 6) AS fine_share, round(100.0 * avg({WIN.format('x', 'y')}), 6) AS share, round(100.0 * avg((x = y)::INTEGER), 6) AS pct_ties,
round(100.0 * avg({WIN.format('u', 'v')}), 6) AS rounded_share, round(100.0 * avg((u = v)::INTEGER), 6) AS rounded_pct_ties FROM r GROUP BY model""")
def z3_precision(spark, sf):
    """Scores that came rounded, and what becomes of shares and ties when all are rounded so."""
    p = pairs(spark, sf).select("model", (1 + F.col("a").cast("double")).alias("x"), (1 + F.col("b").cast("double")).alias("y"))
    return rounded(companions.by_precision(p, "x", "y", "model"), "fine_share", "share", "pct_ties", "rounded_share", "rounded_pct_ties")


@query("""WITH r AS (SELECT DISTINCT o_orderpriority AS k FROM orders) SELECT k AS model, CASE k WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'none' ELSE 'low' END AS label FROM r""")
def z15_labels(spark, sf):
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "none", "5-LOW": "low"}
    return companions.labelled(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("model")).distinct(), "model", names)


@query("""SELECT o_custkey AS unit, count(*) AS n_items, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY o_custkey""")
def z37_work_units(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), "o_orderkey", "o_orderpriority")
    return companions.work_units(o, "unit", "o_orderkey", F.col("o_orderpriority") != "4-NOT SPECIFIED")


@query("""WITH p AS (SELECT p_partkey, p_name AS title, p_size || CASE WHEN p_partkey % 3 = 0 THEN '.01' ELSE '.00' END AS code FROM part) SELECT lower(trim(title)) AS title, arg_min(regexp_replace(code, '\\.00$', ''), p_partkey) AS code FROM p WHERE code LIKE '%.00' GROUP BY 1""")
def z41_base_codes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".01").otherwise(".00")).alias("soc"))
    return companions.base_codes(p, "name", "soc", "p_partkey")


@query(f"""WITH {PAIRS}, d AS (SELECT o_orderkey, o_orderdate::DATE AS scored FROM orders), day AS (SELECT min(scored) AS day FROM d), s AS (SELECT w.* FROM w JOIN d ON o_orderkey = orderkey, day WHERE year(scored) = year(day))
SELECT model, round(50.0 * sum(half) FILTER (category = 'a') / count(*) FILTER (category = 'a'), 6) AS a, round(50.0 * sum(half) FILTER (category = 'b') / count(*) FILTER (category = 'b'), 6) AS b FROM s GROUP BY model""")
def z14_p18_scoped_shares(spark, sf):
    """Shares of both categories by model, of what was scored in the first year only."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), F.trunc(F.col("o_orderdate").cast("date"), "year").alias("scored"))
    first = o.agg(F.min("scored").alias("day"))
    inside = companions.scoped(o.crossJoin(F.broadcast(first)), "scored", F.col("day")).select("orderkey")
    sums = shares.cluster_sums(pairs(spark, sf).join(inside, "orderkey"), "model", "category")
    of = lambda c: 50.0 * F.sum(F.when(F.col("category") == c, F.col("half"))) / F.sum(F.when(F.col("category") == c, F.col("n")))
    return rounded(sums.groupBy("model").agg(of("a").alias("a"), of("b").alias("b")), "a", "b")
