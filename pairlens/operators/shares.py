"""Tie-aware win shares by cluster, group and stratum, and what is read off them.

Rows are scored pairs: ``a`` and ``b`` are the two scores. Everything is a sum of half-wins by cluster first;
later steps work on these few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import band, half_wins, leans


def cluster_sums(pairs: DataFrame, *by: str) -> DataFrame:
    """``by, n, half, wins, ties, losses`` of each group."""
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(half_wins(F.col("a"), F.col("b"))).cast("long").alias("half"),
        F.count_if(F.col("a") > F.col("b")).alias("wins"),
        F.count_if(F.col("a") == F.col("b")).alias("ties"),
        F.count_if(F.col("a") < F.col("b")).alias("losses"),
    )


def share(half: Column, n: Column) -> Column:
    """Percent of pairs that a wins, a tie counting a half."""
    return 50.0 * half / n


def win_shares(pairs: DataFrame, *by: str, cluster: str = "cluster") -> DataFrame:
    """n, clusters, percentages of wins, ties and losses, tie-aware share and match rates, by group.

    Two steps: sums by cluster, then by group; a group is never re-read for another statistic.
    """
    c = pairs.groupBy(*by, cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(half_wins(F.col("a"), F.col("b"))).alias("half"),
        F.count_if(F.col("a") > F.col("b")).alias("wins"),
        F.count_if(F.col("a") == F.col("b")).alias("ties"),
        F.count_if(leans(F.col("category"), F.col("a"), F.col("b"))).alias("matched"),
        F.count_if(F.col("category").isin("a", "b")).alias("typed"),
        F.count_if(F.col("category").isin("a", "b") & (F.col("a") == F.col("b"))).alias("typed_ties"),
    )
    return c.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_clusters"),
        (100.0 * F.sum("wins") / F.sum("n")).alias("pct_a"),
        (100.0 * F.sum("ties") / F.sum("n")).alias("pct_tie"),
        share(F.sum("half"), F.sum("n")).alias("share_a"),
        F.try_divide(100.0 * F.sum("matched"), F.sum("typed")).alias("match_rate"),
        F.try_divide(100.0 * (F.sum("matched") + 0.5 * F.sum("typed_ties")), F.sum("typed")).alias("match_rate_tie_aware"),
    )


def rolled_up(pairs: DataFrame, *by: str) -> DataFrame:
    """Tie-aware shares of every group and of all together."""
    return pairs.rollup(*by).agg(F.count(F.lit(1)).alias("n"), share(F.sum(half_wins(F.col("a"), F.col("b"))), F.count(F.lit(1))).alias("share_a"))


def contrast(pairs: DataFrame, *by: str) -> DataFrame:
    """Share in category a minus share in category b, in points."""
    of = lambda k, x: F.sum(F.when(F.col("category") == k, x))
    w = half_wins(F.col("a"), F.col("b"))
    typed = pairs.filter(F.col("category").isin("a", "b"))
    g = typed.groupBy(*by).agg(of("a", w).alias("wa"), of("a", F.lit(1)).alias("na"), of("b", w).alias("wb"), of("b", F.lit(1)).alias("nb"))
    return g.select(*by, share(F.col("wa"), F.col("na")).alias("share_a_typed"), share(F.col("wb"), F.col("nb")).alias("share_b_typed"), (share(F.col("wa"), F.col("na")) - share(F.col("wb"), F.col("nb"))).alias("contrast"))


def stratum_contrasts(pairs: DataFrame, model: str, stratum: str) -> DataFrame:
    """By model: how many levels of a stratum have a positive contrast, and is it all of them."""
    c = contrast(pairs, model, stratum)
    return c.groupBy(model).agg(F.count(F.lit(1)).alias("levels"), F.count_if(F.col("contrast") > 0).alias("positive"), F.bool_and(F.col("contrast") > 0).alias("all_positive"), F.min("contrast").alias("least"), F.max("contrast").alias("most"))


def across(df: DataFrame, value: str) -> DataFrame:
    """One row over models: n, mean, median, extremes, counts around 50."""
    v = F.col(value)
    return df.agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.count_if(v > 50).alias("above"), F.count_if(v < 50).alias("below"), F.count_if(v == 50).alias("even"),
    )


def spread(pairs: DataFrame, model: str, stratum: str) -> DataFrame:
    """Median and largest range of a model's shares over the levels of a stratum."""
    s = cluster_sums(pairs, model, stratum).withColumn("s", share(F.col("half"), F.col("n")))
    r = s.groupBy(model).agg((F.max("s") - F.min("s")).alias("range"))
    return r.agg(F.median("range").alias("median_range"), F.max("range").alias("max_range"))


def consistency(pairs: DataFrame, model: str, cluster: str = "cluster") -> DataFrame:
    """How many clusters lean as their category says, and how many are exactly even."""
    c = cluster_sums(pairs, model, cluster, "category").withColumn("s", share(F.col("half"), F.col("n")))
    return c.groupBy(model, "category").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(((F.col("category") == "a") & (F.col("s") > 50)) | ((F.col("category") == "b") & (F.col("s") < 50))).alias("as_expected"),
        F.count_if(F.col("s") == 50).alias("even"),
    )


def label_views(pairs: DataFrame, views: dict[str, Column], cluster: str = "cluster") -> DataFrame:
    """Shares by category under several labellings of the same clusters; cluster sums are made once."""
    sums = cluster_sums(pairs, "model", cluster, "pct")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("view"), v.alias("category")) for k, v in views.items()])).alias("v")
    long = sums.select("model", "n", "half", each).select("model", "v.*", "n", "half").filter("category <> 'drop'")
    return long.groupBy("view", "model", "category").agg(F.sum("n").alias("n"), share(F.sum("half"), F.sum("n")).alias("share_a"))


def cutoffs(pairs: DataFrame, cuts: list[tuple[int, int]], cluster: str = "cluster") -> DataFrame:
    """Contrast under other cut-points of the bands."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame(cuts, "low int, high int")
    sums = cluster_sums(pairs, "model", cluster, "pct").crossJoin(F.broadcast(grid)).withColumn("category", band(F.col("pct"), F.col("low"), F.col("high")))
    of = lambda k, c: F.sum(F.when(F.col("category") == k, F.col(c)))
    return sums.groupBy("model", "low", "high").agg((share(of("a", "half"), of("a", "n")) - share(of("b", "half"), of("b", "n"))).alias("contrast"))


def subsets(rows: DataFrame, sets: list[list[str]], *aggs: Column) -> DataFrame:
    """Aggregates over overlapping subsets in one pass of grouping sets; ``level`` tells which columns group."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, names)).agg(F.grouping_id().alias("level"), *aggs)


def moments(pairs: DataFrame, *by: str) -> DataFrame:
    """Mean, spread, median, effect size and shape of the score differences."""
    d = F.col("d")
    return pairs.groupBy(*by).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.median(d).alias("median"),
        F.try_divide(F.avg(d), F.stddev_samp(d)).alias("cohen_d"), F.skewness(d).alias("skew"), F.kurtosis(d).alias("excess_kurtosis"), F.avg(F.abs(d)).alias("mean_gap"),
        F.percentile(F.abs(d), F.lit(0.95)).alias("p95_gap"), F.max(F.abs(d)).alias("max_gap"), (100.0 * F.count_if(d == 0) / F.count(d)).alias("pct_zero"),
    )


def occupancy(counts: DataFrame, value: str, *by: str) -> DataFrame:
    """Effective number of holders, 1 / sum of squared shares, and the three largest holders' share."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    p = counts.withColumn("p", F.col(value) / F.sum(value).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("p"))))
    return p.groupBy(*by).agg((1.0 / F.sum(F.col("p") * F.col("p"))).alias("effective"), F.sum(F.when(F.col("r") <= 3, F.col("p"))).alias("top3"), F.count(F.lit(1)).alias("holders"))


def headline(pairs: DataFrame, *by: str) -> DataFrame:
    """The figures an audit opens with, of pairs whose category is not dropped: sizes, shares, contrast, ties, and the scores' number and range.

    Distinct scores are counted over both sides of the pairs, in a step of their own.
    """
    kept = pairs.filter(F.col("category") != "drop")
    half = half_wins(F.col("a"), F.col("b"))
    in_ = lambda k, x: F.sum(F.when(F.col("category") == k, x))
    n = lambda k: F.count_if(F.col("category") == k)
    g = kept.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), n("a").alias("n_a"), n("b").alias("n_b"), n("neutral").alias("n_neutral"), share(F.sum(half), F.count(F.lit(1))).alias("share_a"),
        (F.try_divide(50.0 * in_("a", half), n("a")) - F.try_divide(50.0 * in_("b", half), n("b"))).alias("contrast"), (100.0 * F.count_if(F.col("a") == F.col("b")) / F.count(F.lit(1))).alias("pct_tie"),
        F.min(F.least("a", "b")).alias("least"), F.max(F.greatest("a", "b")).alias("most"), F.avg(F.abs("d")).alias("mean_gap"),
    )
    scores = kept.select(*by, F.explode(F.array("a", "b")).alias("x")).groupBy(*by).agg(F.count_distinct("x").alias("distinct_scores"))
    return g.join(scores, list(by))


def construction_stats(pairs: DataFrame, built: str, *by: str) -> DataFrame:
    """n, ties, share and mean gap by how a pair was built, and how many times the group's mean gap all of ``by`` have."""
    sums = pairs.groupBy(*by, built).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_ties"), F.sum(half_wins(F.col("a"), F.col("b"))).alias("half"), F.sum(F.abs("d")).alias("gap"),
    )
    whole = sums.groupBy(*by).agg((F.sum("gap") / F.sum("n")).alias("all_gap"))
    gap = F.col("gap") / F.col("n")
    return sums.join(whole, list(by)).select(*by, built, "n", "n_ties", share(F.col("half"), F.col("n")).alias("share_a"), gap.alias("mean_gap"), F.try_divide("all_gap", gap).alias("ratio"))


def set_statistics(models: DataFrame, model: str, before: str, after: str, variants: dict[str, list]) -> DataFrame:
    """Medians and counts over the models, for each variant without the models it names. ``models`` has one row a model."""
    out = None
    for name, without in variants.items():
        kept = models.filter(~F.col(model).isin(without)) if without else models
        one = kept.agg(
            F.count(F.lit(1)).alias("models"), F.median(before).alias("median_before"), F.median(after).alias("median_after"),
            F.count_if(F.col(after) > F.col(before)).alias("n_above"), F.median(F.col(after) - F.col(before)).alias("median_change"),
        ).select(F.lit(name).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def indeterminate(intervals: DataFrame, models: DataFrame, model: str) -> DataFrame:
    """How many models' closed interval holds 50, over all of ``models``; one without an interval is an error, not left out."""
    said = F.raise_error(F.concat(F.lit("no interval for "), F.col(model).cast("string")))
    all_ = models.select(model).distinct().join(intervals, model, "left").withColumn("holds", F.when(F.col("low").isNull() | F.col("high").isNull(), said.cast("boolean")).otherwise(F.lit(50.0).between(F.col("low"), F.col("high"))))
    return all_.agg(F.count(F.lit(1)).alias("models"), F.count_if("holds").alias("indeterminate"))


def residue(identical: Column, win: Column, tie: Column, loss: Column) -> dict[str, Column]:
    """Percentages among the pairs that are still different, from those of all pairs; null where none is.

    Pairs of identical text are ties; the other ties are between different texts.
    """
    left = F.nullif(100.0 - identical, F.lit(0.0))
    ties = F.greatest(tie - identical, F.lit(0.0))
    of = lambda x: F.try_divide(100.0 * x, left)
    return {"pct_of_pairs": 100.0 - identical, "pct_a": of(win), "pct_tie": of(ties), "pct_b": of(loss), "share_a": of(win + 0.5 * ties)}


def slates(ranked: DataFrame, depths: list[int], marked: str, *by: str, rank: str = "rank") -> DataFrame:
    """By group, and over all (``by`` null): the percentage of marked members in the first places, as ratios of sums, and among all members."""
    top = [x for k in depths for x in (F.count_if((F.col(rank) <= k) & F.col(marked)).alias(f"m{k}"), F.count_if(F.col(rank) <= k).alias(f"n{k}"))]
    sums = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(marked).alias("m"), *top)
    pct = lambda x, y: F.try_divide(100.0 * F.sum(x), F.sum(y))
    return sums.rollup(*by).agg(F.sum("n").alias("members"), pct("m", "n").alias("pct_all"), *[pct(f"m{k}", f"n{k}").alias(f"pct_top{k}") for k in depths])


def significance_overview(models: DataFrame, model: str, effect: str, p: str, adjusted: str, alpha: float = 0.05) -> DataFrame:
    """One row over the models: how many by sign and significance, the effects' median and extremes, and who is an exception."""
    e, low, holm = F.col(effect), F.col(p) < alpha, F.col(adjusted) < alpha
    names = lambda x: F.array_join(F.sort_array(F.collect_list(F.when(x, F.col(model)))), ",")
    return models.agg(
        F.count(F.lit(1)).alias("n_models"), F.count_if(e < 0).alias("n_negative"), F.count_if(low).alias("n_low"), F.count_if(holm).alias("n_adjusted_low"),
        F.count_if(low & (e < 0)).alias("n_negative_low"), F.count_if(low & (e > 0)).alias("n_positive_low"), F.count_if(holm & (e < 0)).alias("n_negative_adjusted_low"),
        F.median(e).alias("median"), F.min(e).alias("least"), F.max(e).alias("most"), names(e >= 0).alias("not_negative"), names(~holm).alias("not_adjusted_low"),
    )
