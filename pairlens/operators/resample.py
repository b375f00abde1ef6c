"""Resampling on cluster sums: a draw is a row, its weights are counts, percentiles are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_int, pick


def numbered(clusters: DataFrame, key: str, *by: str) -> DataFrame:
    """Clusters numbered from 0 within their stratum, with the stratum's size."""
    w = Window.partitionBy(*by).orderBy(key) if by else Window.partitionBy(F.lit(0)).orderBy(key)
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return clusters.withColumn("j", F.row_number().over(w) - 1).withColumn("k", F.count(F.lit(1)).over(every).cast("int"))


def weights(clusters: DataFrame, key: str, draws: int, seed: str, *by: str) -> DataFrame:
    """``by, b, key, times``: how often each cluster is drawn in each of ``draws`` resamples of its stratum.

    The cluster table is small (it was aggregated before); it is broadcast only below Spark's own size check.
    """
    spark = clusters.sparkSession
    few = numbered(clusters.select(*by, key).distinct(), key, *by)
    rows = few.select(*by, F.col("j").alias("slot"), "k").crossJoin(spark.range(draws).select(F.col("id").alias("b")))
    drawn = rows.select(*by, "b", pick(F.col("k"), seed, *[F.col(c) for c in by], F.col("b"), F.col("slot")).cast("int").alias("j"))
    counted = drawn.groupBy(*by, "b", "j").agg(F.count(F.lit(1)).alias("times"))
    return counted.join(few.select(*by, "j", key), [*by, "j"]).select(*by, "b", key, "times")


def interval(draws: DataFrame, value: str, *by: str) -> DataFrame:
    """95 percent percentile interval of a statistic over draws, and the share of draws above zero."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*by).agg(p[0].alias("low"), p[1].alias("high"), F.stddev_samp(value).alias("sd"), (100.0 * F.count_if(F.col(value) > 0) / F.count(value)).alias("pct_positive"))


def ratio_bootstrap(sums: DataFrame, num: str, den: str, key: str, draws: int, seed: str, *by: str, scale: float = 1.0) -> DataFrame:
    """Interval of scale * sum(num) / sum(den) under resampled clusters, by group; draws without weight are left out."""
    w = weights(sums, key, draws, seed, *by)
    s = w.join(sums, [*by, key]).groupBy(*by, "b").agg((scale * F.sum(F.col("times") * F.col(num)) / F.nullif(F.sum(F.col("times") * F.col(den)), F.lit(0))).alias("value"))
    point = sums.groupBy(*by).agg((scale * F.sum(num) / F.sum(den)).alias("point"), F.count(F.lit(1)).alias("clusters"))
    found = interval(s, "value", *by)
    return point.join(found, list(by)) if by else point.crossJoin(found)


def draw_contrasts(sums: DataFrame, key: str, draws: int, seed: str, model: str = "model") -> DataFrame:
    """``model, b, value``: share in category a minus share in b, clusters resampled within category."""
    w = weights(sums.select("category", key).distinct(), key, draws, seed, "category")
    t = w.join(sums, ["category", key])
    of = lambda k, c: F.sum(F.when(F.col("category") == k, F.col("times") * F.col(c)))
    return t.groupBy(model, "b").agg((50.0 * of("a", "half") / of("a", "n") - 50.0 * of("b", "half") / of("b", "n")).alias("value"))


def two_way_contrasts(sums: DataFrame, key: str, other: str, draws: int, seed: str, model: str = "model") -> DataFrame:
    """As ``draw_contrasts``, with a second factor resampled too; a cell's weight is the product of both."""
    w = weights(sums.select("category", key).distinct(), key, draws, seed, "category")
    v = weights(sums.select(other).distinct(), other, draws, f"{seed}-other").withColumnRenamed("times", "times2")
    t = sums.join(w, ["category", key]).join(v, ["b", other]).withColumn("times", F.col("times") * F.col("times2"))
    of = lambda k, c: F.sum(F.when(F.col("category") == k, F.col("times") * F.col(c)))
    return t.groupBy(model, "b").agg((50.0 * of("a", "half") / F.nullif(of("a", "n"), F.lit(0)) - 50.0 * of("b", "half") / F.nullif(of("b", "n"), F.lit(0))).alias("value"))


def paired_difference(sums: DataFrame, one: tuple[str, str], two: tuple[str, str], key: str, draws: int, seed: str) -> DataFrame:
    """Interval of ratio two minus ratio one, the same clusters drawn for both."""
    w = weights(sums, key, draws, seed)
    r = lambda x: F.sum(F.col("times") * F.col(x[0])) / F.sum(F.col("times") * F.col(x[1]))
    s = w.join(sums, key).groupBy("b").agg((r(two) - r(one)).alias("value"))
    point = sums.agg((F.sum(two[0]) / F.sum(two[1]) - F.sum(one[0]) / F.sum(one[1])).alias("point"))
    return point.crossJoin(interval(s, "value"))


def leave_one_out(sums: DataFrame, key: str, num: Column | str, den: Column | str, *by: str) -> DataFrame:
    """Range of the ratio over the tables without one cluster: totals less each, no re-reading."""
    t = sums.groupBy(*by, key).agg(F.sum(num).alias("x"), F.sum(den).alias("y"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    t = t.withColumn("v", (F.sum("x").over(w) - F.col("x")) / (F.sum("y").over(w) - F.col("y")))
    return t.groupBy(*by).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max_by(key, F.struct("v", key)).alias("most_without"))


def permuted(items: DataFrame, key: str, draws: int, seed: str, *by: str) -> DataFrame:
    """``by, b, key, rn``: for each draw, the items in a random order (by hash, then key), numbered from 1."""
    spark = items.sparkSession
    rows = items.select(*by, key).distinct().crossJoin(spark.range(draws).select(F.col("id").alias("b")))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by, "b").orderBy(hash_int(seed, F.col("b"), F.col(key)), key)))


def cutoff_contrasts(sums: DataFrame, key: str, draws: int, seed: str, cut: str) -> DataFrame:
    """By cut: category a's share minus b's with its interval, clusters resampled within cut and category.

    ``sums`` has a row a cut and cluster: its category under that cut, ``half`` and ``n``. A cut without clusters of
    both categories has no contrast.
    """
    typed = sums.filter(F.col("category").isin("a", "b")).withColumn("stratum", F.concat_ws("/", F.col(cut).cast("string"), "category"))
    of = lambda k, x: F.sum(F.when(F.col("category") == k, x))
    gap = lambda t: 50.0 * of("a", t * F.col("half")) / of("a", t * F.col("n")) - 50.0 * of("b", t * F.col("half")) / of("b", t * F.col("n"))
    drawn = weights(typed, key, draws, seed, "stratum").join(typed, ["stratum", key]).groupBy(cut, "b").agg(gap(F.col("times")).alias("value"))
    found = interval(drawn, "value", cut).select(cut, "low", "high", (F.col("low") > 0).alias("above_zero"), (F.col("high") < 0).alias("below_zero"))
    return typed.groupBy(cut).agg(gap(F.lit(1)).alias("contrast")).join(found, cut)


def mean_change(rows: DataFrame, unit: str, before: str, after: str, draws: int, seed: str, *by: str, slack: float = 1e-12) -> DataFrame:
    """Levels before and after, and the mean over units of the units' mean change with an interval that resamples the units.

    ``up`` and ``down`` count rows that change by more than ``slack``. Only sums by unit are resampled.
    """
    d = F.col(after) - F.col(before)
    s = rows.groupBy(*by, unit).agg(
        F.count(F.lit(1)).alias("n"), F.sum(before).alias("x"), F.sum(after).alias("y"), F.avg(d).alias("d"), F.count_if(d > slack).alias("up"), F.count_if(d < -slack).alias("down"), F.lit(1).alias("one"),
    )
    level = s.groupBy(*by).agg((F.sum("x") / F.sum("n")).alias("before"), (F.sum("y") / F.sum("n")).alias("after"), F.sum("up").alias("up"), F.sum("down").alias("down"))
    change = ratio_bootstrap(s, "d", "one", unit, draws, seed, *by).select(*by, F.col("point").alias("change"), "low", "high")
    return level.join(change, list(by)) if by else level.crossJoin(change)
