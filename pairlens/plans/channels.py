"""One channel alone against the whole design; placeholders with arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import placeholders
from ..functions.scalars import half_wins
from ..operators import channels, shares
from .fixtures import PAIRS, pairs, table
from .registry import query
from .shares import DRAWS, interval_sql, rounded

CELL = ["model", "cluster", "category", "query", "template"]
#: The arms: all pairs, cells with their names averaged (whole numbers, so equal means are equal), and cells of large quantities alone.
ARMS = f"""{PAIRS}, cell AS (SELECT model, cluster, category, query, template, name, sum(round(100 * a)::BIGINT) AS xa, sum(round(100 * b)::BIGINT) AS xb, sum(round(100 * a)::BIGINT) FILTER (quantity > 25) AS ya, sum(round(100 * b)::BIGINT) FILTER (quantity > 25) AS yb FROM pairs WHERE category <> 'drop' GROUP BY ALL),
g AS (SELECT model, cluster, category, query, template, sum(xa) AS xa, sum(xb) AS xb, sum(ya) AS ya, sum(yb) AS yb, count(*) AS n_items FROM cell GROUP BY ALL),
arms AS (SELECT model, 'original' AS arm, category, cluster, sum(half)::BIGINT AS half, count(*) AS n FROM w WHERE category IN ('a', 'b') GROUP BY ALL
  UNION ALL SELECT model, 'averaged', category, cluster, sum(CASE WHEN xa > xb THEN 2 WHEN xa = xb THEN 1 ELSE 0 END)::BIGINT, count(*) FROM g WHERE category IN ('a', 'b') GROUP BY ALL
  UNION ALL SELECT model, 'alone', category, cluster, sum(CASE WHEN ya > yb THEN 2 WHEN ya = yb THEN 1 ELSE 0 END)::BIGINT, count(*) FROM g WHERE category IN ('a', 'b') AND ya IS NOT NULL GROUP BY ALL)"""


def cells(spark, sf):
    h = lambda c, keep=None: F.sum(F.when(keep, F.round(100 * F.col(c)).cast("long")) if keep is not None else F.round(100 * F.col(c)).cast("long"))
    large = F.col("quantity") > 25
    p = pairs(spark, sf).filter("category <> 'drop'").groupBy(*CELL, "name").agg(h("a").alias("xa"), h("b").alias("xb"), h("a", large).alias("ya"), h("b", large).alias("yb"))
    return p.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in ("xa", "xb", "ya", "yb")], F.count(F.lit(1)).alias("n_items"))


def arms(spark, sf):
    g = cells(spark, sf).filter("category in ('a', 'b')")
    of = lambda name, x, y: g.filter(F.col(x).isNotNull()).groupBy("model", F.lit(name).alias("arm"), "category", "cluster").agg(F.sum(half_wins(F.col(x), F.col(y))).alias("half"), F.count(F.lit(1)).alias("n"))
    whole = shares.cluster_sums(pairs(spark, sf).filter("category in ('a', 'b')"), "model", "category", "cluster").select("model", F.lit("original").alias("arm"), "category", "cluster", "half", "n")
    return whole.unionByName(of("averaged", "xa", "xb")).unionByName(of("alone", "ya", "yb"))


CONTRASTS = f"""{ARMS}, {interval_sql('cluster', 'category', 'arms', DRAWS, 'channel', 'category')},
v AS (SELECT model, arm, b, 50.0 * sum(times * half) FILTER (t.category = 'a') / sum(times * n) FILTER (t.category = 'a') - 50.0 * sum(times * half) FILTER (t.category = 'b') / sum(times * n) FILTER (t.category = 'b') AS value FROM times t JOIN arms a ON a.category = t.category AND a.cluster = t.cluster GROUP BY ALL),
p AS (SELECT model, arm, 50.0 * sum(half) FILTER (category = 'a') / sum(n) FILTER (category = 'a') - 50.0 * sum(half) FILTER (category = 'b') / sum(n) FILTER (category = 'b') AS contrast FROM arms GROUP BY ALL),
levels AS (SELECT model, arm, any_value(contrast) AS contrast, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM v JOIN p USING (model, arm) GROUP BY ALL),
changes AS (SELECT x.model, x.arm, y.arm AS against, any_value(p.contrast - q.contrast) AS change, quantile_cont(x.value - y.value, 0.025) AS low, quantile_cont(x.value - y.value, 0.975) AS high FROM v x JOIN v y ON x.model = y.model AND x.b = y.b AND x.arm <> y.arm
  JOIN p ON p.model = x.model AND p.arm = x.arm JOIN p q ON q.model = y.model AND q.arm = y.arm GROUP BY ALL)"""


@query(f"WITH {CONTRASTS} SELECT model, arm, against, round(change, 6) + 0.0 AS change, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high FROM changes UNION ALL SELECT model, arm, '', round(contrast, 6) + 0.0, round(low, 6) + 0.0, round(high, 6) + 0.0 FROM levels")
def z31_z32_paired_channels(spark, sf):
    """Every arm's contrast and every change between arms, with paired intervals."""
    levels, changes = channels.paired_contrasts(arms(spark, sf), "arm", "cluster", DRAWS, "channel")
    both = changes.unionByName(levels.select("model", "arm", F.lit("").alias("against"), F.col("contrast").alias("change"), "low", "high"))
    return rounded(both, "change", "low", "high")


OVER = "count(*) FILTER (low > 0) AS {p}above, count(*) FILTER (high < 0) AS {p}below, count(*) FILTER (low <= 0 AND high >= 0) AS {p}about"


@query(f"""WITH {CONTRASTS}, l AS (SELECT arm, count(*) AS models, {OVER.format(p='')}, median(contrast) AS median, min(contrast) AS least, max(contrast) AS most FROM levels GROUP BY arm), c AS (SELECT arm, median(change) AS median_change, {OVER.format(p='change_')} FROM changes WHERE against = 'original' GROUP BY arm)
SELECT arm, models, above, below, about, round(median, 6) + 0.0 AS median, round(least, 6) + 0.0 AS least, round(most, 6) + 0.0 AS most, round(median_change, 6) + 0.0 AS median_change, change_above, change_below, change_about FROM l LEFT JOIN c USING (arm)""")
def z32_channel_overview(spark, sf):
    return rounded(channels.overview(*channels.paired_contrasts(arms(spark, sf), "arm", "cluster", DRAWS, "channel")), "median", "least", "most", "median_change")


@query(f"""WITH {PAIRS}, c AS (SELECT model, cluster, category, query, template, count(DISTINCT name) AS n_items, count(DISTINCT pct) = 1 AND count(DISTINCT (query + 1)) = 1 AS ok FROM pairs GROUP BY ALL),
s AS (SELECT category, model, query, count(*) AS n, count(*) FILTER (NOT ok) AS bad, count(*) FILTER (n_items <> 10) AS short FROM c GROUP BY ALL), u AS (SELECT category, count(DISTINCT cluster) AS units FROM c GROUP BY category)
SELECT category, sum(n)::BIGINT AS comparisons, count(*) AS requests, min(n) AS least, max(n) AS most, sum(bad)::BIGINT AS not_collapsed, sum(short)::BIGINT AS incomplete, any_value(units) AS units, sum(bad) = 0 AND sum(short) = 0 AND min(n) = max(n) AS holds FROM s JOIN u USING (category) GROUP BY category""")
def z27_design_checks(spark, sf):
    """Do the names of each cell collapse to one comparison, and do requests have the size that the design wants?"""
    c = channels.collapsed(pairs(spark, sf).withColumn("next", F.col("query") + 1), CELL, "name", "pct", "next")
    return channels.design_checks(c, "cluster", "category", ["model", "query"], 10)


@query(f"""WITH {ARMS}, one AS (SELECT model, count(*) AS n, avg(abs(ya - yb)) AS mean_gap, median(abs(ya - yb)) AS median_gap FROM g WHERE ya IS NOT NULL GROUP BY model), two AS (SELECT model, avg(abs(xa - xb)) AS yardstick FROM cell GROUP BY model)
SELECT model, n, round(mean_gap, 6) AS mean_gap, round(median_gap, 6) AS median_gap, round(yardstick, 6) AS yardstick, round(mean_gap / yardstick, 6) AS ratio FROM one JOIN two USING (model) WHERE model <> 'N'""")
def z36_channel_gaps(spark, sf):
    """The gaps of one channel's cells against those of single names, without a model that did not reproduce."""
    h = lambda c: F.sum(F.round(100 * F.col(c)).cast("long"))
    names = pairs(spark, sf).filter("category <> 'drop'").groupBy(*CELL, "name").agg((h("a") - h("b")).alias("gap"))
    cell = cells(spark, sf).filter("ya is not null").withColumn("gap", F.col("ya") - F.col("yb"))
    return rounded(channels.gap_ratio(cell, names, "model", F.col("gap"), ["N"]), "mean_gap", "median_gap", "yardstick", "ratio")


@query("""WITH e AS (SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL) SELECT event_id, 'k is ' || k::BIGINT || ', ' || printf('%.1f', k * 2 / 4 - 1) || ' of ' || printf('%.2f', (k + 1) * 100) AS said FROM e""")
def k12_expressions(spark, sf):
    """Arithmetic over paths in placeholders, compiled to one Column."""
    e = table(spark, sf, "events").select("event_id", F.parse_json("props").alias("doc")).filter(F.try_variant_get("doc", "$.k", "double").isNotNull())
    return e.select("event_id", placeholders.filled("doc", "k is {{[k]|d}}, {{[k] * 2 / 4 - 1|.1f}} of {{([k] + 1) * 100|.2f}}").alias("said"))
