"""Tests and associations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sinks.shared import kept
from .prefix import value_ranks
from .resample import permuted


def holm(df: DataFrame, p: str, key: str) -> DataFrame:
    """Holm's step-down adjustment, in the order of p, then key."""
    w = Window.partitionBy(F.lit(0)).orderBy(p, key)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    adj = df.withColumn("rank", F.row_number().over(w)).withColumn("raw", F.least(F.lit(1.0), (m - F.col("rank") + 1) * F.col(p)))
    return adj.withColumn("p_holm", F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("rank", "raw")


def bonferroni(df: DataFrame, p: str) -> DataFrame:
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return df.withColumn("p_bonferroni", F.least(F.lit(1.0), m * F.col(p)))


def label_permutation(sums: DataFrame, key: str, draws: int, seed: str) -> DataFrame:
    """Is the contrast larger than under shuffled labels? Whole-number statistic k * S - k_a * T, p = (1 + #) / (1 + B).

    Labels move between typed clusters; the first k_a of a random order are called a.
    """
    typed = sums.filter("category in ('a', 'b')").groupBy("model", key, "category").agg(F.sum("half").alias("half"))
    size = typed.select(key, "category").distinct().agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("category") == "a").alias("ka"))
    order = permuted(typed, key, draws, seed).crossJoin(F.broadcast(size)).filter("rn <= ka").select("b", key)
    total = typed.groupBy("model").agg(F.sum("half").alias("t"), F.sum(F.when(F.col("category") == "a", F.col("half"))).alias("sa")).crossJoin(F.broadcast(size))
    drawn = order.join(typed.select("model", key, "half"), key).groupBy("model", "b").agg(F.sum("half").alias("s"))
    stat = drawn.join(total, "model").select("model", (F.col("k") * F.col("s") - F.col("ka") * F.col("t")).alias("v"), (F.col("k") * F.col("sa") - F.col("ka") * F.col("t")).alias("seen"))
    return stat.groupBy("model").agg(((1 + F.count_if(F.col("v") >= F.col("seen"))) / (1.0 + draws)).alias("p_one_sided"), ((1 + F.count_if(F.abs("v") >= F.abs("seen"))) / (1.0 + draws)).alias("p_two_sided"))


def average_rank(value: str, *by: str) -> Column:
    """Mean rank, 1 the smallest."""
    w = Window.partitionBy(*by).orderBy(value)
    same = Window.partitionBy(*by, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    r = df.withColumn("rx", average_rank(x, *by)).withColumn("ry", average_rank(y, *by))
    return r.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman_permutation(df: DataFrame, x: str, y: str, key: str, draws: int, seed: str, by: str = "model") -> DataFrame:
    """p of Spearman's rho when x's ranks are dealt out anew: p = (1 + #{|rho*| >= |rho| - 1e-12}) / (1 + B)."""
    r = df.withColumn("rx", average_rank(x, by)).withColumn("ry", average_rank(y, by)).withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(key)))
    rho = r.groupBy(by).agg(F.corr("rx", "ry").alias("rho"))
    order = permuted(df, key, draws, seed, by)
    shuffled = order.join(r.select(by, key, "rx"), [by, key]).join(r.select(by, F.col("at").alias("rn"), "ry"), [by, "rn"])
    star = shuffled.groupBy(by, "b").agg(F.corr("rx", "ry").alias("star"))
    return star.join(rho, by).groupBy(by, "rho").agg(((1 + F.count_if(F.abs("star") >= F.abs("rho") - 1e-12)) / (1.0 + draws)).alias("p"))


def kendall(df: DataFrame, x: str, y: str, key: str, by: str) -> DataFrame:
    """Kendall's tau-b from the pairs of each group."""
    l, r = df.alias("l"), df.alias("r")
    c = lambda t, n: F.col(f"{t}.{n}")
    pairs = l.join(r, (c("l", by) == c("r", by)) & (c("l", key) < c("r", key))).select(c("l", by).alias(by), F.signum(c("l", x) - c("r", x)).alias("sx"), F.signum(c("l", y) - c("r", y)).alias("sy"))
    return pairs.groupBy(by).agg((F.sum(F.col("sx") * F.col("sy")) / F.sqrt(F.sum(F.abs("sx")) * F.sum(F.abs("sy")))).alias("tau"))


def regression(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.regr_r2(y, x).alias("r2"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts b and c (also the exact binomial test at a half); 1 if there are none."""

    @F.pandas_udf(DoubleType())
    def p(b: pd.Series, c: pd.Series) -> pd.Series:
        def one(x: int, y: int) -> float:
            n, k = x + y, min(x, y)
            if n == 0:
                return 1.0
            logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]) - n * math.log(2)
            return min(1.0, 2 * float(np.exp(logs - logs.max()).sum() * math.exp(logs.max())))

        return pd.Series([one(int(x), int(y)) for x, y in zip(b, c, strict=True)])

    return p(b, c)


def mcnemar_small(b: Column, c: Column) -> Column:
    """The same from factorials, for at most 20 discordant pairs; null beyond."""
    n, k = b + c, F.least(b, c)
    terms = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.lit(0.0), lambda s, i: s + F.factorial(n) / (F.factorial(i) * F.factorial(n - i)))
    return F.when(n == 0, 1.0).when(n <= 20, F.least(F.lit(1.0), 2.0 * terms / F.pow(F.lit(2.0), n)))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.struct((mid - half).alias("low"), (mid + half).alias("high"))


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal p, from the error function's series in Abramowitz and Stegun 7.1.26 (1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def wilcoxon(df: DataFrame, d: str, *by: str) -> DataFrame:
    """Signed-rank sums of the non-zero differences, the normal z without continuity correction, and its two-sided p.

    The variance is corrected for ties. p is the normal one at every number of differences. Differences are counted by size, and
    only the counts are ranked.
    """
    nz = df.filter(F.col(d) != 0).groupBy(*by, F.abs(d).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(d) > 0).alias("up"))
    r = value_ranks(nz, list(by), "m")
    n, rank = F.col("n"), F.col("avg_rank")
    g = r.groupBy(*by).agg(F.sum(n * n * n - n).alias("ties"), F.sum(rank * F.col("up")).alias("w_plus"), F.sum(rank * (n - F.col("up"))).alias("w_minus"), F.sum("n").alias("n"))
    mean, var = F.col("n") * (F.col("n") + 1) / 4.0, F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("ties") / 48.0
    return g.withColumn("z", (F.col("w_plus") - mean) / F.sqrt(var)).drop("ties").withColumn("p", normal_two_sided(F.col("z")))


def one_sample_t(df: DataFrame, d: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(d).alias("n"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"))


def chi2_tail(x: Column, k: Column) -> Column:
    """P(chi-square with k degrees of freedom > x), by the finite sum that whole k have."""
    half, even = x / 2.0, k % 2 == 0
    first = F.when(even, F.lit(1.0)).otherwise(F.sqrt(half) / (math.sqrt(math.pi) / 2))
    step = F.when(even, F.lit(1.0)).otherwise(F.lit(1.5))
    number = F.floor(k / 2).cast("int")  # of terms
    state = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))
    total = F.aggregate(F.sequence(F.lit(0), number), state, lambda s, i: F.struct((s["sum"] + F.when(i < number, s["term"]).otherwise(0.0)).alias("sum"), (s["term"] * half / (i + step)).alias("term")))["sum"]
    return F.when(even, F.exp(-half) * total).otherwise(normal_two_sided(F.sqrt(x)) + F.exp(-half) * total)


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H, corrected for ties, and its chi-square p, over the groups of one table; both null if all values are equal.

    The counts are written once: a mean that is computed again may differ in its last digit, and would not meet its own rank.
    """
    cells = kept(df.filter(F.col(value).isNotNull()).groupBy(value, group).agg(F.count(F.lit(1)).alias("k")), "cells")
    r = value_ranks(cells.groupBy(value).agg(F.sum("k").alias("t")), [], value, "t").join(cells, value)
    g = r.groupBy(group).agg(F.sum(F.col("avg_rank") * F.col("k")).alias("s"), F.sum("k").alias("n"), F.sum((F.col("t") * F.col("t") - 1) * F.col("k")).alias("ties"))
    n = F.sum("n")
    h = 12.0 / (n * (n + 1)) * F.sum(F.col("s") * F.col("s") / F.col("n")) - 3 * (n + 1)
    g = g.agg(F.count(F.lit(1)).alias("groups"), n.alias("n"), h.alias("h"), F.sum("ties").alias("ties"))
    n = F.col("n").cast("double")
    g = g.withColumn("h", F.col("h") / F.nullif(1 - F.col("ties") / F.nullif(n * n * n - n, F.lit(0.0)), F.lit(0.0))).drop("ties")
    return g.withColumn("p", chi2_tail(F.col("h"), F.col("groups") - 1))


def independence_baseline(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Observed agreement of two yes/no columns against what independent ones would have."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(x).cast("int")).alias("px"), F.avg(F.col(y).cast("int")).alias("py"), F.count_if(F.col(x) == F.col(y)).alias("same"))
    base = F.col("n") * (F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py")))
    return g.agg((F.sum("same") / F.sum("n")).alias("agreement"), (F.sum(base) / F.sum("n")).alias("baseline"))
